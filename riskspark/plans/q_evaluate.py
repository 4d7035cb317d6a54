"""Queries: splits, metrics, thresholds, drift, accounting and telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskspark.functions import scalar as S
from riskspark.operators import drift as D
from riskspark.operators import evaluate as E
from riskspark.operators import ops as O
from riskspark.operators.distsort import global_row_number, rank_threshold
from riskspark.plans import features as P
from riskspark.plans.q_sources import _decisions
from riskspark.plans.query import register
from riskspark.plans.views import challenger, keyed_events, message_log, scored, stage_latency, transactions, tx_labels
from riskspark.session import broadcast_if_small

QUERIES: dict = {}


@register(QUERIES, "split_temporal")
def split_temporal(spark, sf_dir):
    return E.split_temporal(transactions(spark, sf_dir, 300)).select("transaction_id", "split")


@register(QUERIES, "split_summary")
def split_summary(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    return E.split_summary(E.split_temporal(tx), numbers=["origin_balance", "latitude"])


@register(QUERIES, "split_stratified")
def split_stratified(spark, sf_dir):
    """With the ordinal code of the payment type in alphabetical order."""
    tx = transactions(spark, sf_dir)
    kinds = global_row_number(tx.select("payment_type").where("payment_type is not null").distinct(), [F.col("payment_type")], "_code")
    return E.split_stratified(tx).join(broadcast_if_small(kinds), "payment_type", "left").select(
        "transaction_id", "split", (F.col("_code") - 1).cast("int").alias("type_code"))


@register(QUERIES, "features_32_by_split")
def features_32_by_split(spark, sf_dir):
    from riskspark.plans.q_features import model_columns
    out = P.features_by_split(E.split_temporal(transactions(spark, sf_dir)))
    return out.select("transaction_id", "split", *model_columns(out))


@register(QUERIES, "f_vector_32")
def f_vector_32(spark, sf_dir):
    """The float vector: its length and the sum of its whole-number entries."""
    out = P.vector(P.features_32(transactions(spark, sf_dir)))
    whole = F.col("features")
    return out.select("transaction_id", F.size(whole).alias("dimension"),
                      *[F.get(whole, F.lit(i)).cast("int").alias(f"x{i}") for i in (2, 3, 5, 6, 7, 8, 11, 26, 28, 29)])


@register(QUERIES, "f_vector_validate")
def f_vector_validate(spark, sf_dir):
    out = P.features_32(transactions(spark, sf_dir)).withColumns({
        "amount_zscore": F.expr("case when k % 11 = 0 then double('NaN') else amount_zscore end"),
        "log_amount": F.expr("case when k % 13 = 0 then double('Infinity') when k % 17 = 0 then null else log_amount end")})
    return P.vector_faults(out).select("transaction_id", F.array_join("bad_features", ",").alias("bad_features"))


@register(QUERIES, "audit_profile")
def audit_profile(spark, sf_dir):
    tx = transactions(spark, sf_dir).selectExpr(
        "customer_id", "category", "payment_type", "is_fraud", "case when k % 9 <> 0 then k end as maybe", "k % 3 as small")
    return E.audit(tx, "is_fraud", "payment_type")


@register(QUERIES, "weights_grid")
def weights_grid(spark, sf_dir):
    df = scored(spark, sf_dir).join(transactions(spark, sf_dir).select("transaction_id", "k"), "transaction_id").selectExpr(
        "label", "p as calibrated_probability", "k % 7 / 7D as velocity_signal", "k % 5 / 5D as behavioral_signal",
        "k % 9 / 9D as rules_signal", "k % 10 / 10D as anomaly_signal", "k % 33 = 0 as hard_block")
    return E.weight_study(df)


@register(QUERIES, "validate_features")
def validate_features(spark, sf_dir):
    tx = transactions(spark, sf_dir).selectExpr(
        "cast(amount as double) as amount", "origin_balance", "cast(k as double) as k",
        "case when k % 7 = 0 then double('NaN') when k % 11 = 0 then null else latitude end as latitude")
    return E.validate_features(tx, ["amount", "origin_balance", "k", "latitude"])


QUERIES["m_confusion"] = lambda spark, sf_dir: E.confusion(scored(spark, sf_dir), 0.3)
QUERIES["m_brier"] = lambda spark, sf_dir: E.brier(scored(spark, sf_dir))
QUERIES["m_ece"] = lambda spark, sf_dir: E.ece(scored(spark, sf_dir))
QUERIES["m_tiers"] = lambda spark, sf_dir: E.tiers(scored(spark, sf_dir), 0.158, 0.5516)
for _m in ("roc_auc", "pr_auc", "avg_precision", "recall_at_fpr"):
    QUERIES[f"m_{_m}"] = (lambda m: lambda spark, sf_dir: E.ranking_metrics(E.curve(scored(spark, sf_dir))).select(m))(_m)


@register(QUERIES, "thr_optimize")
def thr_optimize(spark, sf_dir):
    points = E.curve(scored(spark, sf_dir))
    return E.thresholds(points, policy="online").withColumn("policy", F.lit("online")).unionByName(
        E.thresholds(points, policy="training").withColumn("policy", F.lit("training")))


QUERIES["thr_cost_curve"] = lambda spark, sf_dir: E.cost_curve(
    scored(spark, sf_dir).withColumn("p", F.col("p4")), steps=[t * 10000 for t in range(10, 95, 10)]).withColumn(
    "threshold", (F.col("threshold") / 10000).cast("int"))
QUERIES["imb_class_weight"] = lambda spark, sf_dir: E.class_weights(scored(spark, sf_dir))
QUERIES["imb_undersample"] = lambda spark, sf_dir: E.undersample(scored(spark, sf_dir), ratio=3.0).select("transaction_id", "label")


def model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking metrics of two scorers on three slices of the data, in one pass each."""
    tag = lambda df, m: df.withColumns({"model": F.lit(m), "dataset": F.concat(F.lit("d"), F.col("event_id") % 3)})
    both = tag(scored(spark, sf_dir), "production").unionByName(tag(challenger(spark, sf_dir), "candidate"))
    return E.ranking_metrics(E.curve(both, group=["model", "dataset"]), group=["model", "dataset"])


QUERIES["select_candidate"] = lambda spark, sf_dir: E.select_candidate(model_metrics(spark, sf_dir))
QUERIES["bench_pivot"] = lambda spark, sf_dir: E.pivot_metric(model_metrics(spark, sf_dir), "pr_auc", ["d0", "d1", "d2"])


@register(QUERIES, "gate_promotion")
def gate_promotion(spark, sf_dir):
    """Rank metrics, Brier score and false positive rate of both scorers."""
    tag = lambda df, m: df.withColumn("role", F.lit(m))
    both = tag(scored(spark, sf_dir), "production").unionByName(tag(challenger(spark, sf_dir), "candidate"))
    rank = E.ranking_metrics(E.curve(both, group=["role"]), group=["role"])
    other = both.groupBy("role").agg(
        S.rnd(F.avg(F.pow(F.col("p") - F.col("label"), 2)), 6).alias("brier_score"),
        S.rnd(F.sum(((F.col("p") >= 0.5) & (F.col("label") == 0)).cast("int")) / F.sum((F.col("label") == 0).cast("int")), 6).alias("fpr"))
    return E.promotion_gate(rank.join(other, "role")).select(
        "production_pr_auc", "candidate_pr_auc", "production_roc_auc", "candidate_roc_auc", "pr_auc_ok", "roc_auc_ok",
        "brier_ok", "fpr_ok", "status")


@register(QUERIES, "labeled_training_set")
def labeled_training_set(spark, sf_dir):
    d = _decisions(spark, sf_dir).join(
        tx_labels(spark, sf_dir).select("transaction_id", "fraud_label", F.col("reported_us").alias("label_us")), "transaction_id", "left")
    return E.labeled_set(d, 1_705_000_000_000_000).select("transaction_id", "fraud_label", "label_order")


def drift_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tx = transactions(spark, sf_dir)
    median, _ = rank_threshold(tx, "us", tx.count() // 2)
    cols = ["cast(amount as double) as amount", "origin_balance", "cast(k as double) as k",
            "case when auth_verified then 1D else 0D end as auth", "1D as constant"]
    shifted = ["cast(amount as double) * 1.5D as amount", *cols[1:]]
    return tx.where(F.col("us") < median).selectExpr(*cols), tx.where(F.col("us") >= median).selectExpr(*shifted)


DRIFTED = ["amount", "origin_balance", "k", "auth", "constant"]


@register(QUERIES, "psi_feature")
def psi_feature(spark, sf_dir):
    out = D.psi(*drift_sides(spark, sf_dir), DRIFTED)
    return out.select("feature", "n_ref", "n_cur", "psi", "severity", F.coalesce(F.size("bins"), F.lit(0)).alias("n_bins"))


QUERIES["psi_assess"] = lambda spark, sf_dir: D.assess(D.psi(*drift_sides(spark, sf_dir), DRIFTED))
QUERIES["label_mature"] = lambda spark, sf_dir: O.mature_labels(tx_labels(spark, sf_dir), 1_706_200_000_000_000).groupBy(
    "state", "fraud_label").agg(F.count(F.lit(1)).alias("n"))


@register(QUERIES, "replay_ordered")
def replay_ordered(spark, sf_dir):
    tx = _decisions(spark, sf_dir).withColumns({"us": F.col("created_us"), "scenario": F.concat(F.lit("s"), F.col("event_id") % 4)})
    return O.scenario_summary(O.replay(tx, lambda df: df))


QUERIES["ledger_reconcile"] = lambda spark, sf_dir: O.reconcile(message_log(spark, sf_dir), "event_id")
QUERIES["latency_summary"] = lambda spark, sf_dir: O.latency_summary(stage_latency(spark, sf_dir))
QUERIES["latency_histogram"] = lambda spark, sf_dir: O.latency_histogram(stage_latency(spark, sf_dir))
QUERIES["lag_trend"] = lambda spark, sf_dir: O.lag_trend(keyed_events(spark, sf_dir).selectExpr(
    "event_id", "us", "user_id % 20 as partition", "k % 40 as lag"))
QUERIES["counters"] = lambda spark, sf_dir: O.error_counters(keyed_events(spark, sf_dir).selectExpr(
    "case k % 4 when 0 then 'Kafka' when 1 then 'model' when 2 then 'disk' else 'redis' end as component",
    "case k % 3 when 0 then 'TIMEOUT' when 1 then 'odd' else 'not_found' end as error_type"))
