"""The 32 point-in-time features of a transaction table as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskspark.constants import FEATURES
from riskspark.functions import scalar as S
from riskspark.operators import windows as W
from riskspark.operators.hotkeys import DEFAULT, Census, Limits, census

MAX_CATEGORIES = 200_000


def category_frequency(train: DataFrame, counted: Census | None = None) -> DataFrame:
    """Rows per category and over all categories; kept as counts so that it stays exact."""
    if counted is None:
        counted = census(train, {}, {"category": F.coalesce("category", F.lit("None"))})
    counts = counted.of("category").select(F.col("category").alias("_c"), F.col("_n").alias("_rows"))
    return counts.withColumn("_all", F.lit(counted.rows.get("category", 1)))


def category_code(df: DataFrame, frequency: DataFrame) -> DataFrame:
    """Whole thousandths of the trained frequency; an unseen category has 1."""
    side = F.broadcast(frequency) if frequency.count() <= MAX_CATEGORIES else frequency
    return (
        df.join(side, F.coalesce("category", F.lit("None")) == F.col("_c"), "left")
        .withColumn("merchant_category_enc", F.coalesce(
            F.floor(F.col("_rows").cast("double") / F.col("_all") * 1000).cast("int"), F.lit(1)))
        .drop("_c", "_rows", "_all")
    )


def static_columns(df: DataFrame) -> DataFrame:
    amount, us = F.col("amount"), F.col("us")
    hour, weekday = S.given(df, "hour_of_day", S.hour_of(us)), S.given(df, "day_of_week", S.weekday_of(us))
    out = {
        "log_amount": S.log_amount(amount),
        "payment_type_enc": S.payment_code(F.coalesce("payment_type", F.lit("TRANSFER"))),
        "amount_to_balance_ratio": S.balance_ratio(amount, F.col("origin_balance")),
        "hour_of_day": hour, "day_of_week": weekday,
        "is_weekend": S.is_weekend(weekday), "is_night": S.is_night(hour),
        "cyclic_hour_sin": S.hour_sin(hour), "cyclic_hour_cos": S.hour_cos(hour),
        "auth_factor_verified": F.coalesce("auth_verified", F.lit(True)).cast("int"),
    }
    return df.withColumns(out)


def features_32(tx: DataFrame, train: DataFrame | None = None, anomaly: Column | None = None,
                limits: Limits = DEFAULT, scope: str = "customer_id") -> DataFrame:
    """All features plus the input columns (``amount`` keeps its decimal type).

    Exchanges of the wide rows: one by customer, one by device. ``scope`` may be a column that
    combines the customer with a split, to restart history per split.
    """
    keep = tx.columns
    counted = W.take_census(tx, limits, scope)
    out = category_code(tx, category_frequency(tx, counted) if train is None else category_frequency(train))
    out = W.with_new_location(out, tx, limits, scope, counted)
    out = W.history_windows(out, limits, scope, counted)
    out = W.device_users(out, tx, limits, scope, counted)
    out = W.behavior_columns(out)
    out = W.previous_event_columns(out)
    out = W.home_distance(out)
    out = W.new_device_column(out)
    out = static_columns(out)
    out = out.withColumns({
        "deterministic_rule_count": S.rule_count(
            F.col("amount"), F.col("origin_balance"), F.col("auth_factor_verified"),
            F.col("speed_kmh_from_prev_tx"), F.col("tx_count_1m")),
        "isolation_forest_score": anomaly if anomaly is not None else F.lit(0.10),
    })
    return out.select(*keep, *[f for f in FEATURES if f not in keep])


def features_by_split(tx: DataFrame, train: DataFrame | None = None, limits: Limits = DEFAULT) -> DataFrame:
    """History restarts at every split boundary; ``tx`` carries ``split``."""
    scoped = tx.withColumn("_scope", F.concat_ws("\u0001", F.col("split"), F.col("customer_id")))
    fit_on = tx.where("split = 'train'") if train is None else train
    return features_32(scoped, fit_on, limits=limits, scope="_scope").drop("_scope")


def vector(df: DataFrame) -> DataFrame:
    """The frozen order as one array of floats."""
    return df.withColumn("features", F.array(*[F.col(f).cast("float") for f in FEATURES]))


def vector_faults(df: DataFrame) -> DataFrame:
    """Names of features that are missing, NaN or infinite; an empty array is a valid row."""
    def bad(f: str) -> Column:
        x = F.col(f).cast("double")
        return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(f))
    return df.withColumn("bad_features", F.array_compact(F.array(*[bad(f) for f in FEATURES])))
