"""Canonical views over the driver's parquet tables.

The expressions are plain SQL so that the same text can be checked by another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TX_COLUMNS = """
  concat('tx_', cast(e.event_id as string)) as transaction_id,
  e.event_id,
  e.us,
  cast(e.v * 25 as decimal(18,2)) as amount,
  concat('c', cast(e.user_id as string)) as customer_id,
  concat('m', cast((e.event_id * 7) % 97 as string)) as merchant_id,
  e.event_type as category,
  case e.k % 7 when 0 then 'TRANSFER' when 1 then 'CASH_OUT' when 2 then 'PAYMENT'
    when 3 then 'DEBIT' when 4 then 'CASH_IN' when 5 then 'CREDIT_CARD' else 'WIRE' end
    as payment_type,
  case when e.k % 9 = 0 or c.c_acctbal is null or c.c_acctbal < 0 then cast(0 as double)
    else c.c_acctbal end as origin_balance,
  case when e.k % 25 = 3 then cast(0 as double)
    when e.k % 20 = 7 then cast(10 + e.user_id % 50 + 9 as double)
    else cast(10 + e.user_id % 50 as double) + (e.k % 5) * cast(0.01 as double) end as latitude,
  case when e.k % 25 = 3 then cast(0 as double)
    when e.k % 20 = 7 then cast(20 + e.user_id % 60 + 9 as double)
    else cast(20 + e.user_id % 60 as double) + (e.k % 5) * cast(0.01 as double) end as longitude,
  cast(10 + e.user_id % 50 as double) as home_latitude,
  cast(20 + e.user_id % 60 as double) as home_longitude,
  case when e.k % 10 = 0 then 'unknown_device'
    else concat('d', cast(e.user_id + e.k % 6 as string)) end as device_id,
  e.k % 8 <> 0 as auth_verified,
  case when e.k < 6 or (e.k % 8 = 0 and e.v > 100) then 1 else 0 end as is_fraud,
  e.k, e.v, e.user_id
"""


def keyed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where("value > 0")
    return events.select(
        "event_id", "user_id", "event_type",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.col("value").cast("decimal(18,2)").alias("v"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def transactions(spark: SparkSession, sf_dir: str, squeeze: int = 1) -> DataFrame:
    """The ``tx`` view; ``squeeze`` divides time to make short windows busy."""
    events = keyed_events(spark, sf_dir)
    if squeeze > 1:
        events = events.withColumn("us", F.expr(f"us div {squeeze}"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    joined = events.alias("e").join(customer.alias("c"), F.expr("e.user_id = c.c_custkey"), "left")
    return joined.selectExpr(*_split(TX_COLUMNS))


def _split(text: str) -> list[str]:
    """Top-level commas of a select list."""
    parts, depth, current = [], 0, ""
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            parts.append(current)
            current = ""
        else:
            current += ch
    return [p.strip() for p in parts + [current]]


P4 = "least(9900, 200 + 5000 * is_fraud + k * 40 + cast(floor(least(v, 100) * 10) as int))"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows; the score is a whole number of 1/10000 so that it is exact everywhere."""
    tx = transactions(spark, sf_dir)
    return tx.selectExpr(
        "transaction_id", "event_id", "us", "customer_id", "is_fraud as label", f"{P4} as p4",
    ).withColumn("p", F.expr("p4 / cast(10000 as double)"))


def challenger(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.expr("greatest(0, least(10000, p4 + cast((event_id % 11) - 5 as int) * 200))")
    return scored(spark, sf_dir).withColumn("p4", shifted).withColumn(
        "p", F.expr("p4 / cast(10000 as double)"))


def security_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).selectExpr(
        "customer_id", "us", "device_id", "event_id as source_id",
        "case when k % 17 = 0 then 'mfa_reset' when k % 19 = 0 then 'credential_stuffing_attempt'"
        " when category = 'click' then 'device_change' when category = 'view' then 'profile_update'"
        " when category = 'error' then 'login_anomaly'"
        " when category = 'signup' then 'new_device_registration'"
        " else 'password_change' end as event_type",
        "concat('10.0.', cast(k % 7 as string), '.', cast(k as string)) as ip_address",
    )


def tx_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delayed labels for every third transaction, plus ids that were never decided."""
    tx = transactions(spark, sf_dir)
    own = tx.where("event_id % 3 = 0").selectExpr(
        "transaction_id", "us as original_us", "is_fraud as fraud_label",
        "us + 14 * 86400000000 as reported_us")
    stray = tx.where("event_id % 97 = 5").selectExpr(
        "concat('lost_', cast(event_id as string)) as transaction_id", "us as original_us",
        "1 as fraud_label", "us + 14 * 86400000000 as reported_us")
    return own.unionByName(stray)


def mandates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "concat('man', cast(c_custkey as string)) as mandate_id",
        "concat('c', cast(c_custkey as string)) as customer_id",
        "concat('b', cast(c_custkey % 13 as string)) as beneficiary_id",
        "cast(500 + c_custkey % 1500 as decimal(18,2)) as max_amount",
        "case c_custkey % 4 when 0 then 'DAILY' when 1 then 'WEEKLY' when 2 then 'MONTHLY'"
        " else 'ONCE' end as frequency",
        "case when c_custkey % 11 = 3 then 'PAUSED' else 'ACTIVE' end as status",
        "cast(694224000000000 as bigint) as created_us",
        "cast(694224000000000 as bigint) + (365 + c_custkey % 5 * 400) * 86400000000 as expires_us",
    )


def mandate_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.expr("concat('man', cast(o_custkey as string))").alias("mandate_id"),
        F.col("o_orderkey").alias("attempt_id"),
        F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"),
        F.expr("cast(cast(o_totalprice as decimal(18,2)) / 100 as decimal(18,2))").alias("amount"),
    )


def holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).where("event_id % 20 = 0").selectExpr(
        "concat('hold_', cast(event_id as string)) as hold_id", "transaction_id", "customer_id",
        "merchant_id", "amount", "us as created_us", "k", "event_id")


def hold_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first action per hold and, for some, a conflicting one a minute later."""
    first = holds(spark, sf_dir).selectExpr(
        "hold_id", "1 as seq", "case when k % 2 = 0 then 'CONFIRM' else 'DENY' end as action",
        "k % 13 <> 0 as token_ok", "created_us + k * 7 * 1000000 as us", "k")
    second = first.where("k % 5 = 0").selectExpr(
        "hold_id", "2 as seq", "case when action = 'CONFIRM' then 'DENY' else 'CONFIRM' end as action",
        "true as token_ok", "us + 60 * 1000000 as us", "k")
    return first.unionByName(second).drop("k")


def message_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = keyed_events(spark, sf_dir).selectExpr(
        "event_id", "us", "case event_id % 50 when 0 then 'failed' when 1 then 'dlq'"
        " when 2 then 'pending' when 3 then 'missing' else 'processed' end as status")
    return base.selectExpr(
        "event_id", "us", "status",
        "explode(sequence(1, case when event_id % 40 = 0 then 2 else 1 end)) as copy")


def stage_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed_events(spark, sf_dir).selectExpr(
        "case k % 7 when 0 then 'kafka_consume' when 1 then 'redis' when 2 then 'feature_engine'"
        " when 3 then 'model' when 4 then 'risk_engine' when 5 then 'serialization'"
        " else 'e2e' end as stage", "event_id", "us", "v as latency")
