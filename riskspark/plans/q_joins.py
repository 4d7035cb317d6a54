"""Queries: as-of state, joins and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskspark.operators import asof as A
from riskspark.operators import workflow as K
from riskspark.operators.distsort import global_row_number
from riskspark.plans.q_sources import _decisions
from riskspark.plans.query import register
from riskspark.plans.views import (
    challenger, hold_actions, holds, message_log, scored, security_events, transactions, tx_labels,
)

QUERIES: dict = {}


def _probes(spark: SparkSession, sf_dir: str, squeeze: int = 1) -> DataFrame:
    """As-of questions: the customer of every fifth transaction, one second after it."""
    return transactions(spark, sf_dir, squeeze).where("event_id % 5 = 0").selectExpr(
        "customer_id", "us + 1000000 as us", "event_id as probe_id")


@register(QUERIES, "state_velocity_asof")
def state_velocity_asof(spark, sf_dir):
    return A.velocity_at(transactions(spark, sf_dir, 300), _probes(spark, sf_dir, 300)).drop("customer_id", "us")


@register(QUERIES, "state_behavior_asof")
def state_behavior_asof(spark, sf_dir):
    return A.behavior_at(transactions(spark, sf_dir), _probes(spark, sf_dir)).drop("customer_id", "us")


@register(QUERIES, "state_last_location")
def state_last_location(spark, sf_dir):
    return A.last_location(transactions(spark, sf_dir))


@register(QUERIES, "state_customer_devices")
def state_customer_devices(spark, sf_dir):
    return A.device_edges(transactions(spark, sf_dir))


@register(QUERIES, "state_device_customers")
def state_device_customers(spark, sf_dir):
    """The same edges read from the device: its customers in order, each with its place among them. A device that
    very many customers share stays spread over tasks."""
    edges = A.device_edges(transactions(spark, sf_dir))
    return global_row_number(edges, [F.col("customer_id")], "place", ["device_id"])


def _last_per_customer(spark, sf_dir, squeeze=1):
    return transactions(spark, sf_dir, squeeze).groupBy("customer_id").agg(F.max("us").alias("probe_us"))


@register(QUERIES, "state_recent_history")
def state_recent_history(spark, sf_dir):
    """Events of the week before each customer's latest one."""
    history = transactions(spark, sf_dir).select("customer_id", "us", "transaction_id", F.col("amount").cast("double").alias("amount"))
    return A.interval_join(_last_per_customer(spark, sf_dir), history, "customer_id", 7 * A.DAY)


@register(QUERIES, "j_interval_history")
def j_interval_history(spark, sf_dir):
    history = transactions(spark, sf_dir, 300).select("customer_id", "us", (F.col("amount") * 100).cast("bigint").alias("cents"))
    pairs = A.interval_join(_last_per_customer(spark, sf_dir, 300), history, "customer_id", 3600 * A.SECOND, inclusive=True)
    return pairs.groupBy("customer_id", "probe_us").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))


@register(QUERIES, "j_ledger_decision")
def j_ledger_decision(spark, sf_dir):
    out = A.ledger_view(transactions(spark, sf_dir), _decisions(spark, sf_dir).where("event_id % 7 <> 0"))
    return out.select("transaction_id", F.col("amount").cast("double").alias("amount"), "decision", "risk_score")


@register(QUERIES, "j_label_attach")
def j_label_attach(spark, sf_dir):
    decisions = _decisions(spark, sf_dir).where("event_id % 2 = 0").withColumns({
        "risk_level": F.lit("MEDIUM"), "workflow_status": F.lit("FINAL")})
    return A.attach_labels(decisions, tx_labels(spark, sf_dir), transactions(spark, sf_dir))


def security_probes(spark, sf_dir):
    return transactions(spark, sf_dir).select("customer_id", "us", "transaction_id", "amount")


@register(QUERIES, "j_asof_security_state")
def j_asof_security_state(spark, sf_dir):
    out = K.security_state(security_probes(spark, sf_dir), security_events(spark, sf_dir))
    counts = [c for c in out.columns if c.startswith("n_") and c not in ("n_other", "n_followed")]
    return out.select("transaction_id", *counts)


def _compared(spark, sf_dir):
    prod = scored(spark, sf_dir).selectExpr(
        "transaction_id", "p4 / 100D as score",
        "case when p4 >= 7000 then 'BLOCK' when p4 >= 3000 then 'REVIEW' else 'APPROVE' end as decision")
    return A.shadow_compare(prod, challenger(spark, sf_dir).selectExpr("transaction_id", "p4 / 100D as score"))


QUERIES["j_shadow_compare"] = _compared
QUERIES["shadow_divergence"] = lambda spark, sf_dir: A.shadow_divergence(_compared(spark, sf_dir))


@register(QUERIES, "j_hold_actions")
def j_hold_actions(spark, sf_dir):
    h = holds(spark, sf_dir).select("hold_id", "transaction_id", "created_us")
    return hold_actions(spark, sf_dir).join(h, "hold_id").selectExpr(
        "hold_id", "transaction_id", "seq", "action", "(us - created_us) div 1000000 as after_s",
        "us <= created_us + 300000000 as in_window")


@register(QUERIES, "j_anti_replay")
def j_anti_replay(spark, sf_dir):
    return A.replays(message_log(spark, sf_dir), "event_id").where("duplicates > 0")


@register(QUERIES, "j_lookup_points")
def j_lookup_points(spark, sf_dir):
    """Newest pending holds, newest rows of one customer, and one row by id."""
    tx, h = transactions(spark, sf_dir), holds(spark, sf_dir)
    pick = lambda df, kind, order: df.selectExpr(f"'{kind}' as kind", "transaction_id", f"{order} as at")
    by_customer = A.newest(tx.where("customer_id = 'c8'"), "us", 20, "transaction_id")
    pending = A.newest(h, "created_us", 50, "transaction_id")
    one = tx.where("transaction_id = 'tx_10'")
    return pick(by_customer, "customer", "us").unionByName(pick(pending, "hold", "created_us")).unionByName(pick(one, "id", "us"))
