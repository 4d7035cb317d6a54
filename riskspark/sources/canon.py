"""From source schemas to the canonical transaction table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from riskspark.constants import SENSITIVE_KEYS, UNKNOWN_DEVICE
from riskspark.functions.scalar import EARTH_KM, rnd
from riskspark.operators.distsort import file_row_number

# Post-event columns of each source, epoch bases and balance proxies.
MOBILE_LEAKS = ["newbalanceOrig", "oldbalanceDest", "newbalanceDest", "isFlaggedFraud"]
CARD_LEAKS = ["trans_num"]
MOBILE_EPOCH, ECOMMERCE_EPOCH = 1_704_067_200, 1_512_086_400
CARD_BALANCE, ECOMMERCE_BALANCE = 5000.0, 10000.0
ECOMMERCE_DEFAULTS = {"DeviceType": "desktop", "DeviceInfo": "unknown",
                      "P_emaildomain": "anonymous.com", "card4": "visa", "card6": "credit"}


def drop_leaks(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


def strip_prefix(df: DataFrame, column: str = "merchant", prefix: str = "fraud_") -> DataFrame:
    return df.withColumn(column, F.regexp_replace(column, f"^{prefix}", ""))


def drop_null_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.dropna(subset=keys)


def impute(df: DataFrame, defaults: dict[str, str] = ECOMMERCE_DEFAULTS) -> DataFrame:
    return df.fillna({k: v for k, v in defaults.items() if k in df.columns})


def with_row_id(df: DataFrame, prefix: str) -> DataFrame:
    """``prefix`` plus the row's position in the source, taken before any row is dropped."""
    return (file_row_number(df, "_row").withColumn("row_id", F.concat(F.lit(prefix), F.col("_row").cast("string")))
            .drop("_row"))


def _micros(seconds) -> F.Column:
    return (seconds * F.lit(1_000_000)).cast("bigint")


def mobile_money(df: DataFrame) -> DataFrame:
    """``df`` carries ``row_id``; one step is one hour."""
    zero = F.lit(0.0)
    return df.select(
        F.col("row_id").alias("transaction_id"),
        _micros(F.lit(MOBILE_EPOCH) + F.col("step").cast("bigint") * 3600).alias("us"),
        F.col("amount").cast("decimal(18,2)").alias("amount"),
        F.col("nameOrig").alias("customer_id"), F.col("nameDest").alias("merchant_id"),
        F.when(F.col("nameDest").startswith("M"), "merchant").otherwise("p2p_transfer").alias("category"),
        F.upper("type").alias("payment_type"), F.col("oldbalanceOrg").alias("origin_balance"),
        zero.alias("latitude"), zero.alias("longitude"), zero.alias("home_latitude"),
        zero.alias("home_longitude"), F.lit(UNKNOWN_DEVICE).alias("device_id"),
        F.lit(True).alias("auth_verified"), (F.col("step") % 24).alias("hour_of_day"),
        (F.floor(F.col("step") / 24) % 7).cast("int").alias("day_of_week"),
        F.col("isFraud").alias("is_fraud"), F.lit("paysim").alias("dataset_source"))


def card(df: DataFrame) -> DataFrame:
    lat1, lon1, lat2, lon2 = (F.radians(c) for c in ("lat", "long", "merch_lat", "merch_long"))
    a = F.pow(F.sin((lat2 - lat1) / 2.0), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2.0), 2)
    km = F.lit(2 * EARTH_KM) * F.asin(F.least(F.sqrt(a), F.lit(1.0)))
    when = F.col("trans_date_trans_time").cast("timestamp_ntz")
    return df.select(
        F.col("row_id").alias("transaction_id"), _micros(F.col("unix_time")).alias("us"),
        F.col("amt").cast("decimal(18,2)").alias("amount"),
        F.concat(F.lit("cc_"), F.col("cc_num").cast("string")).alias("customer_id"),
        F.col("merchant").alias("merchant_id"), "category", F.lit("CREDIT_CARD").alias("payment_type"),
        F.lit(CARD_BALANCE).alias("origin_balance"), F.col("merch_lat").alias("latitude"),
        F.col("merch_long").alias("longitude"), F.col("lat").alias("home_latitude"),
        F.col("long").alias("home_longitude"), rnd(km, 2).alias("distance_from_home_km"),
        F.concat(F.lit("pos_card_"), F.col("cc_num").cast("string")).alias("device_id"),
        F.lit(True).alias("auth_verified"), F.hour(when).alias("hour_of_day"),
        F.weekday(when).alias("day_of_week"), "is_fraud", F.lit("sparkov").alias("dataset_source"))


def ecommerce(df: DataFrame) -> DataFrame:
    zero, dt = F.lit(0.0), F.col("TransactionDT")
    return df.select(
        F.concat(F.lit("ieee_"), F.col("TransactionID").cast("string")).alias("transaction_id"),
        _micros(F.lit(ECOMMERCE_EPOCH) + dt).alias("us"),
        F.col("TransactionAmt").cast("decimal(18,2)").alias("amount"),
        F.concat_ws("_", F.lit("ieee_cust"), F.col("card1").cast("string"),
                    F.coalesce("card2", zero).cast("int").cast("string")).alias("customer_id"),
        F.concat(F.lit("prod_"), "ProductCD").alias("merchant_id"), F.col("ProductCD").alias("category"),
        F.upper("card6").alias("payment_type"), F.lit(ECOMMERCE_BALANCE).alias("origin_balance"),
        zero.alias("latitude"), zero.alias("longitude"), zero.alias("home_latitude"),
        zero.alias("home_longitude"), F.concat_ws("_", "DeviceType", "DeviceInfo").alias("device_id"),
        F.lit(True).alias("auth_verified"),
        (F.floor(dt / 3600) % 24).cast("int").alias("hour_of_day"),
        (F.floor(dt / 86400) % 7).cast("int").alias("day_of_week"),
        F.col("isFraud").alias("is_fraud"), F.lit("ieee_cis").alias("dataset_source"))


def attach_identity(tx: DataFrame, identity: DataFrame | None) -> DataFrame:
    """Device columns by transaction; without an identity file they are ``unknown``."""
    if identity is None:
        return tx.withColumns({"DeviceType": F.lit("unknown"), "DeviceInfo": F.lit("unknown")})
    return tx.join(identity, "TransactionID", "left")


def normalize_location(df: DataFrame) -> DataFrame:
    """Nested or flat places to four columns; a missing home stays null."""
    def pick(nested: str, flat: str):
        options = []
        if nested.split(".")[0] in df.columns:
            options.append(F.col(nested))
        if flat in df.columns:
            options.append(F.col(flat))
        return F.coalesce(*options, F.lit(None).cast("double"))
    return df.withColumns({
        "latitude": F.coalesce(pick("location.latitude", "latitude"), F.lit(0.0)),
        "longitude": F.coalesce(pick("location.longitude", "longitude"), F.lit(0.0)),
        "home_latitude": pick("home_location.latitude", "home_latitude"),
        "home_longitude": pick("home_location.longitude", "home_longitude"),
    })


def union_sources(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def redact(df: DataFrame, column: str = "metadata") -> DataFrame:
    """Mask map values whose key contains a sensitive fragment."""
    tokens = F.array(*[F.lit(t) for t in SENSITIVE_KEYS])
    masked = F.transform_values(column, lambda k, v: F.when(
        F.exists(tokens, lambda t: F.lower(k).contains(t)), F.lit("[REDACTED]")).otherwise(v))
    return df.withColumn(column, masked)
