"""Queries: business rules, signals, fusion and decision events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskspark.constants import WEIGHTS
from riskspark.functions.scalar import rnd
from riskspark.operators import fusion as U
from riskspark.operators import rules as R
from riskspark.plans import features as P
from riskspark.plans.query import register
from riskspark.plans.views import P4, transactions

QUERIES: dict = {}
SQUEEZE = 300


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.features_32(transactions(spark, sf_dir, SQUEEZE))


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored transactions; model probability and anomaly come from the ``scored`` view."""
    return U.score_transactions(
        featured(spark, sf_dir), F.expr(f"{P4} / cast(10000 as double)"),
        F.expr("k % 10 / cast(10 as double)"))


def _rules(category: str | None, hard: bool = False):
    chosen = [r for r in R.DEFAULT_RULES if r.hard == hard and (category is None or r.category == category)]

    def run(spark, sf_dir):
        out = R.match(featured(spark, sf_dir), chosen)
        return out.where("size(matched_rules) > 0").select(
            "transaction_id", F.array_join(F.transform("matched_rules", lambda m: m["rule_id"]), ",").alias("rules"))
    return run


for _name, _category in {"r_velocity": "velocity", "r_amount": "amount", "r_location_device": "location_device",
                         "r_authentication": "authentication", "r_context": "transaction_context"}.items():
    QUERIES[_name] = _rules(_category)
QUERIES["r_hard_block"] = _rules(None, hard=True)


@register(QUERIES, "r_evaluate")
def r_evaluate(spark, sf_dir):
    return R.evaluate(featured(spark, sf_dir)).select(
        "transaction_id", "rules_signal", "hard_block", "rule_decision",
        F.array_join("hard_block_rules", ",").alias("hard_block_rules"),
        F.array_join("rule_reasons", "|").alias("reasons"))


@register(QUERIES, "r_by_category")
def r_by_category(spark, sf_dir):
    return R.hits(R.match(featured(spark, sf_dir)))


@register(QUERIES, "r_custom")
def r_custom(spark, sf_dir):
    """One rule replaced by a stricter one, one rule of the user's own added."""
    rules = R.with_rule(R.DEFAULT_RULES, R.Rule(
        "AUTH_MISSING_STEP_UP", "authentication", "LOW", 10, "No step-up on a larger amount",
        (F.col("auth_factor_verified") == 0) & (F.col("amount") > 100)))
    rules = R.with_rule(rules, R.Rule(
        "CUSTOM_WIRE", "transaction_context", "LOW", 15, "Unlisted rail", F.col("payment_type") == "WIRE"))
    return R.hits(R.match(featured(spark, sf_dir), rules))


@register(QUERIES, "s_velocity")
def s_velocity(spark, sf_dir):
    return featured(spark, sf_dir).select(
        "transaction_id", rnd(U.velocity_signal(F.col("tx_count_5m"), F.col("tx_count_1h")), 6).alias("velocity_signal"))


@register(QUERIES, "s_behavioral")
def s_behavioral(spark, sf_dir):
    s = U.behavioral_signal(F.col("amount_zscore"), F.col("is_new_device"), F.col("is_new_location"))
    return featured(spark, sf_dir).select("transaction_id", rnd(s, 6).alias("behavioral_signal"))


def _raw_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals as they might arrive: some missing, not a number or out of range."""
    return transactions(spark, sf_dir).selectExpr(
        "transaction_id",
        "case when k % 11 = 0 then double('NaN') when k % 13 = 0 then null when k % 7 = 0 then 1.5D"
        " when k % 5 = 0 then -0.25D else k / 100D end as raw")


def _bounded(name: str, fallback: float):
    def run(spark, sf_dir):
        return _raw_signals(spark, sf_dir).select(
            "transaction_id", U.bounded_signal(F.col("raw"), fallback).alias(name))
    return run


QUERIES["s_rules"] = _bounded("rules_signal", 0.0)
QUERIES["s_anomaly"] = _bounded("anomaly_signal", 0.25)


@register(QUERIES, "s_contract")
def s_contract(spark, sf_dir):
    raw = _raw_signals(spark, sf_dir).withColumns({
        "calibrated_probability": F.col("raw"), "velocity_signal": F.lit(0.5),
        "behavioral_signal": F.when(F.col("raw") > 0.9, F.col("raw")).otherwise(0.1),
        "rules_signal": F.lit(1.0), "anomaly_signal": F.col("raw") + F.lit(0.5)})
    loose = U.contract_faults(raw).select("transaction_id", F.array_join("violations", ",").alias("violations"))
    passed, rejected = U.split_contract(_sent_signals(spark, sf_dir))
    routed = passed.select("transaction_id", F.lit("accepted").alias("route"), F.lit("").alias("faults"), F.col("anomaly_signal").alias("anomaly")).unionByName(
        rejected.select("transaction_id", F.lit("rejected").alias("route"), F.array_join("faults", "|").alias("faults"), F.lit(None).cast("double").alias("anomaly")))
    return loose.join(routed, "transaction_id")


def _sent_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals as a sender might spell them: numbers, words, booleans, some left out."""
    pairs = ("'calibrated_probability', case when k % 11 = 0 then 'NaN' when k % 7 = 0 then '1.5' when k % 5 = 0 then '-0.25'"
             " when k % 17 = 0 then 'true' when k % 19 = 0 then 'high' else '0.5' end", "'velocity_signal', '0.5'",
             "'behavioral_signal', case when k % 23 = 0 then 'Infinity' else ' 0.1 ' end", "'rules_signal', '1'",
             "'anomaly_signal', case when k % 3 <> 0 then '0.25' end")
    return transactions(spark, sf_dir).selectExpr("transaction_id", f"map({', '.join(pairs)}) as signals")


@register(QUERIES, "fuse_weighted")
def fuse_weighted(spark, sf_dir):
    parts = [f"part_{s}" for s in WEIGHTS] + [f"share_{s}" for s in WEIGHTS]
    return decided(spark, sf_dir).select("transaction_id", "weighted_score", *parts)


@register(QUERIES, "fuse_escalate")
def fuse_escalate(spark, sf_dir):
    return decided(spark, sf_dir).select(
        "transaction_id", F.array_join("active_triggers", ",").alias("triggers"), "trigger_count", "escalation_boost")


@register(QUERIES, "fuse_decide")
def fuse_decide(spark, sf_dir):
    return decided(spark, sf_dir).select("transaction_id", "risk_score", "decision", "risk_level")


@register(QUERIES, "fuse_full_batch")
def fuse_full_batch(spark, sf_dir):
    return decided(spark, sf_dir).select(
        "transaction_id", "customer_id", "risk_score", "risk_level", "decision", "ml_decision", "hard_block",
        "trigger_count", "weighted_score", F.array_join("reasons", "|").alias("reasons"))


@register(QUERIES, "ml_policy")
def ml_policy(spark, sf_dir):
    p = F.expr(f"{P4} / cast(10000 as double)")
    return transactions(spark, sf_dir).select("transaction_id", p.alias("p"), U.ml_decision(p).alias("ml_decision"))


@register(QUERIES, "decision_event")
def decision_event(spark, sf_dir):
    return U.decision_events(decided(spark, sf_dir)).select(
        "event_id", "transaction_id", "timestamp", "decision", "risk_score", "model_version",
        F.array_join("event_faults", ",").alias("faults"))


@register(QUERIES, "reasons_topk")
def reasons_topk(spark, sf_dir):
    out = U.reasons(U.attributions(featured(spark, sf_dir)))
    return out.select("transaction_id", F.array_join("reasons", "|").alias("reasons"))


def _legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).selectExpr(
        "transaction_id", "cast(event_id % 720 as int) as step", "payment_type as type", "amount",
        "origin_balance as oldbalanceOrg", "cast(auth_verified as int) as auth_verified",
        "case when k % 4 = 0 then 0 else 1 end as device_known", "case when k % 6 = 0 then 0 else 1 end as geo_known",
        "k % 8 as sender_hourly_tx_count", "k % 30 as sender_daily_tx_count",
        "case when k % 9 <> 1 then k / 100D end as receiver_risk_score",
        "case when k % 3 = 0 then 'third_party' else 'self' end as initiated_by")


@register(QUERIES, "heuristic_risk_v0")
def heuristic_risk_v0(spark, sf_dir):
    return U.heuristic_score(_legacy(spark, sf_dir)).select(
        "transaction_id", rnd(F.col("heuristic_score"), 6).alias("score"),
        F.array_join("explanations", "|").alias("explanations"))


@register(QUERIES, "legacy_features_v0")
def legacy_features_v0(spark, sf_dir):
    out = U.legacy_features(_legacy(spark, sf_dir))
    fix = {"amount": F.col("amount").cast("double"), "amount_balance_ratio": rnd(F.col("amount_balance_ratio"), 4)}
    return out.select("transaction_id", *[fix.get(c, F.col(c)).alias(c) for c in U.LEGACY_COLUMNS])


@register(QUERIES, "decision_mix")
def decision_mix(spark, sf_dir):
    return U.decision_mix(decided(spark, sf_dir))
