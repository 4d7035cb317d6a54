"""Queries: scalar features, point-in-time windows and keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskspark.constants import FEATURES
from riskspark.functions import scalar as S
from riskspark.operators import windows as W
from riskspark.plans import features as P
from riskspark.plans.query import register
from riskspark.plans.views import transactions

QUERIES: dict = {}
SQUEEZE = 300


def _tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir)


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir, SQUEEZE)


@register(QUERIES, "f_log_amount")
def f_log_amount(spark, sf_dir):
    return _tx(spark, sf_dir).select("transaction_id", S.rnd(S.log_amount(F.col("amount")), 6).alias("log_amount"))


@register(QUERIES, "f_balance_ratio")
def f_balance_ratio(spark, sf_dir):
    ratio = S.balance_ratio(F.col("amount"), F.col("origin_balance"))
    return _tx(spark, sf_dir).select("transaction_id", S.rnd(ratio, 4).alias("amount_to_balance_ratio"))


@register(QUERIES, "f_time_parts")
def f_time_parts(spark, sf_dir):
    return _tx(spark, sf_dir).select(
        "transaction_id", S.hour_of(F.col("us")).alias("hour_of_day"), S.weekday_of(F.col("us")).alias("day_of_week"))


@register(QUERIES, "f_weekend_night")
def f_weekend_night(spark, sf_dir):
    us = F.col("us")
    return _tx(spark, sf_dir).select(
        "transaction_id", S.is_weekend(S.weekday_of(us)).alias("is_weekend"), S.is_night(S.hour_of(us)).alias("is_night"))


@register(QUERIES, "f_cyclic_hour")
def f_cyclic_hour(spark, sf_dir):
    hour = S.hour_of(F.col("us"))
    return _tx(spark, sf_dir).select(
        "transaction_id", S.hour_sin(hour).alias("cyclic_hour_sin"), S.hour_cos(hour).alias("cyclic_hour_cos"))


@register(QUERIES, "f_payment_enc")
def f_payment_enc(spark, sf_dir):
    return _tx(spark, sf_dir).select("transaction_id", S.payment_code(F.col("payment_type")).alias("payment_type_enc"))


@register(QUERIES, "f_category_freq_enc")
def f_category_freq_enc(spark, sf_dir):
    tx = _tx(spark, sf_dir)
    train = tx.where("category <> 'signup' and event_id % 2 = 0")  # leaves one category unseen
    return P.category_code(tx, P.category_frequency(train)).select("transaction_id", "merchant_category_enc")


@register(QUERIES, "f_haversine")
def f_haversine(spark, sf_dir):
    return W.home_distance(_tx(spark, sf_dir)).select("transaction_id", "distance_from_home_km")


@register(QUERIES, "w_home_distance")
def w_home_distance(spark, sf_dir):
    """Rows without a registered home use their own place."""
    tx = _tx(spark, sf_dir).withColumns({
        c: F.when(F.col("event_id") % 5 != 0, F.col(c)) for c in ("home_latitude", "home_longitude")})
    return W.home_distance(tx).select("transaction_id", "distance_from_home_km")


@register(QUERIES, "w_velocity_counts")
def w_velocity_counts(spark, sf_dir):
    return W.velocity(_dense(spark, sf_dir)).select(
        "transaction_id", "tx_count_1m", "tx_count_5m", "tx_count_15m", "tx_count_1h")


@register(QUERIES, "w_velocity_sums")
def w_velocity_sums(spark, sf_dir):
    return W.velocity(_dense(spark, sf_dir)).select(
        "transaction_id", "amount_sum_5m", "amount_sum_15m", "amount_sum_1h")


def _part(columns, finish):
    def run(spark, sf_dir):
        return finish(W.history_windows(_tx(spark, sf_dir))).select("transaction_id", *columns)
    return run


QUERIES["w_behavior_30d"] = _part(["user_avg_amount_30d", "user_std_amount_30d"], W.behavior_columns)
QUERIES["f_zscore"] = _part(["amount_zscore"], W.behavior_columns)
QUERIES["w_hour_mean_30d"] = _part(["user_mean_hour_30d", "user_hourly_tx_deviation"], lambda df: W.behavior_columns(W.mean_hour(df)))
QUERIES["f_hour_deviation"] = _part(["user_hourly_tx_deviation"], W.behavior_columns)
QUERIES["w_category_share_30d"] = _part(["user_category_frequency"], W.behavior_columns)
QUERIES["w_prev_event"] = _part(["distance_from_prev_loc_km", "speed_kmh_from_prev_tx"], W.previous_event_columns)
QUERIES["f_speed"] = _part(["speed_kmh_from_prev_tx"], W.previous_event_columns)
QUERIES["w_new_device"] = _part(["is_new_device"], W.new_device_column)


@register(QUERIES, "w_new_location")
def w_new_location(spark, sf_dir):
    tx = _tx(spark, sf_dir)
    return W.with_new_location(tx, tx).select("transaction_id", "is_new_location")


@register(QUERIES, "w_device_users_24h")
def w_device_users_24h(spark, sf_dir):
    tx = _tx(spark, sf_dir)
    return W.device_users(W.history_windows(tx), tx).select("transaction_id", "device_user_count_24h")


def model_columns(df: DataFrame) -> list:
    """Features as compared with SQL: exact ones as they are, transcendental ones rounded."""
    out = []
    for f in FEATURES:
        c = F.col(f).cast("double") if f == "amount" else F.col(f)
        if f in ("log_amount", "amount_to_balance_ratio"):
            c = S.rnd(c, 4)
        out.append(c.alias(f))
    return out


@register(QUERIES, "features_32_batch")
def features_32_batch(spark, sf_dir):
    out = P.features_32(_dense(spark, sf_dir))
    return out.select("transaction_id", *model_columns(out))


@register(QUERIES, "f_rule_count")
def f_rule_count(spark, sf_dir):
    return P.features_32(_dense(spark, sf_dir)).select("transaction_id", "deterministic_rule_count")
