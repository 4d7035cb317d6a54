"""Queries: account security, mandates, holds and authorisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskspark.operators import workflow as K
from riskspark.plans.q_joins import security_probes
from riskspark.plans.q_sources import _decisions
from riskspark.plans.query import register
from riskspark.plans.views import (
    hold_actions, holds, mandate_attempts, mandates, security_events, transactions,
)

QUERIES: dict = {}
SECRET = "fixture-secret"


@register(QUERIES, "ato_event_id")
def ato_event_id(spark, sf_dir):
    ev = security_events(spark, sf_dir)
    twice = ev.unionByName(ev.where("source_id % 10 = 0"))
    return K.event_ids(twice).select("event_id", "customer_id", "event_type", "us")


def ato(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.ato_score(K.security_state(security_probes(spark, sf_dir), security_events(spark, sf_dir)))


QUERIES["ato_score"] = lambda spark, sf_dir: ato(spark, sf_dir).select(
    "transaction_id", "events_24h", "password_then_device", "ato_score")
QUERIES["ato_action"] = lambda spark, sf_dir: ato(spark, sf_dir).select(
    "transaction_id", "ato_action", "ato_level", "requires_hold", F.array_join("indicators", "|").alias("indicators"))
QUERIES["ato_guardrail"] = lambda spark, sf_dir: K.guardrail(ato(spark, sf_dir)).select(
    "transaction_id", "allowed", "guardrail_reason")


@register(QUERIES, "mandate_execute")
def mandate_execute(spark, sf_dir):
    return K.execute_mandates(mandate_attempts(spark, sf_dir), mandates(spark, sf_dir)).select(
        "mandate_id", "attempt_id", "us", "accepted", "reject_reason")


@register(QUERIES, "mandate_lifecycle")
def mandate_lifecycle(spark, sf_dir):
    """Commands from the orders of a customer: the order number picks the command."""
    commands = mandate_attempts(spark, sf_dir).selectExpr(
        "mandate_id", "attempt_id as seq",
        "case attempt_id % 13 when 0 then 'cancel' when 1 then 'limit' when 2 then 'limit' when 3 then 'pause'"
        " when 4 then 'pause' when 5 then 'pause' else 'activate' end as command",
        "case when attempt_id % 5 = 0 then -1D else 100D end as new_limit")
    return K.mandate_lifecycle(commands).select("mandate_id", "seq", "command", "status_before", "accepted", "status_after")


def _created(spark, sf_dir):
    h = holds(spark, sf_dir)
    again = h.where("k % 4 = 0").withColumns({
        "created_us": F.col("created_us") + 7, "hold_id": F.concat("hold_id", F.lit("_b"))})
    return K.create_holds(h.unionByName(again).select(
        "transaction_id", "hold_id", "customer_id", "merchant_id", "amount", "created_us", "k"), SECRET)


@register(QUERIES, "hold_create")
def hold_create(spark, sf_dir):
    return _created(spark, sf_dir).select(
        "hold_id", "transaction_id", "customer_id", "created_us", "expires_us", "status",
        "token_hash")


def _resolved(spark, sf_dir):
    return K.resolve_holds(holds(spark, sf_dir), hold_actions(spark, sf_dir))


QUERIES["hold_resolve"] = lambda spark, sf_dir: _resolved(spark, sf_dir)[0].select(
    "hold_id", "transaction_id", "status", "resolved_us")
QUERIES["hold_action_verdicts"] = lambda spark, sf_dir: _resolved(spark, sf_dir)[1]


@register(QUERIES, "hold_expire_sweep")
def hold_expire_sweep(spark, sf_dir):
    as_of = 1_705_500_000_000_000
    return K.expired_holds(holds(spark, sf_dir), hold_actions(spark, sf_dir), as_of).select(
        "hold_id", "status", "resolved_us", "resolution_reason")


@register(QUERIES, "hold_notifications")
def hold_notifications(spark, sf_dir):
    return K.hold_notifications(holds(spark, sf_dir))


def layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with account state and pipeline decision, ready for authorisation."""
    risk = ato(spark, sf_dir).select("transaction_id", "ato_score", "ato_action", "requires_hold")
    pipeline = _decisions(spark, sf_dir).select("transaction_id", "decision", "risk_score")
    return transactions(spark, sf_dir).join(pipeline, "transaction_id").join(risk, "transaction_id")


def authorised(spark, sf_dir):
    return K.authorise(layered(spark, sf_dir))


QUERIES["auth_final"] = lambda spark, sf_dir: authorised(spark, sf_dir).select(
    "transaction_id", "final_decision", "gateway_status", "workflow_status", "money_moves")


@register(QUERIES, "settle_balances")
def settle_balances(spark, sf_dir):
    moved = authorised(spark, sf_dir).where("money_moves")
    return K.settle(moved).select("account", F.col("net").cast("double").alias("net"), "legs")


def _reports(spark, sf_dir):
    return transactions(spark, sf_dir).where("is_fraud = 1 and event_id % 2 = 0").selectExpr(
        "transaction_id", "customer_id", "us + 3600000000 as reported_us",
        "case when k % 2 = 0 then 'PHISHING' else 'UNKNOWN' end as attack_type")


@register(QUERIES, "case_from_report")
def case_from_report(spark, sf_dir):
    out = K.cases_from_reports(_reports(spark, sf_dir), _decisions(spark, sf_dir).where("event_id % 3 <> 0"))
    alerts = out["alerts"].select("transaction_id", "alert_id", "severity", F.col("reason").alias("alert_reason"))
    labels = out["labels"].select("transaction_id", "fraud_label")
    return out["cases"].join(alerts, "transaction_id").join(labels, "transaction_id")


@register(QUERIES, "event_timeline")
def event_timeline(spark, sf_dir):
    return K.timeline(security_events(spark, sf_dir), authorised(spark, sf_dir))


@register(QUERIES, "hold_outcome_apply")
def hold_outcome_apply(spark, sf_dir):
    out = K.apply_hold_outcomes(_decisions(spark, sf_dir), _resolved(spark, sf_dir)[0])
    return out.select("transaction_id", "decision", "workflow_status", "money_moves", "alert_severity")


@register(QUERIES, "alerts_build")
def alerts_build(spark, sf_dir):
    return K.alerts(_decisions(spark, sf_dir))
