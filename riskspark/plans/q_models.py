"""Queries: model fitting, calibration, anomaly scores and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskspark.constants import FEATURES
from riskspark.functions.scalar import rnd
from riskspark.operators import evaluate as E
from riskspark.operators import ml as M
from riskspark.plans import features as P
from riskspark.plans.query import register
from riskspark.plans.views import scored, transactions
from riskspark.session import cut_lineage

QUERIES: dict = {}
# smaller ensembles than the library defaults, so that a check run stays short; fit_baselines and fit_boosted only
FOREST = dict(trees=30, depth=8)
BOOST = dict(rounds=15, depth=4, rate=0.2)


def modelling(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Assembled train, validation and test frames; features are materialised once.

    The frames carry only the columns that fits, splits and scores read."""
    tx = P.features_32(transactions(spark, sf_dir, 300))
    rows = M.assembled(E.split_temporal(cut_lineage(tx)))
    fixed = cut_lineage(rows.select("transaction_id", "event_id", "split", "x", "label", "weight"))
    return tuple(fixed.where(F.col("split") == s) for s in ("train", "val", "test"))


def suite(n: int) -> dict:
    return {"logistic": M.logistic(n), "forest": M.forest(**FOREST), "boosted": M.boosted(**BOOST)}


def contenders(n: int) -> dict:
    """The five models of a benchmark: linear, bagged, and boosted by level, by leaf and with symmetric trees."""
    return {
        "logistic": M.logistic(n, iterations=1000), "forest": M.forest(trees=100, depth=10),
        "boosted": M.boosted(150, 5, growth="level", columns=0.8),
        "leafwise": M.boosted(150, growth="leaf", leaves=31, columns=0.8, l2=0.0, least=1e-3, least_rows=20),
        "symmetric": M.boosted(250, 5, subsample=1.0, growth="symmetric", l2=3.0)}


# the tuning space: rate 0.01 to 0.15 by factors, depth 4 to 8, l2 1 to 10, as 36 points
SPACE = {"depth": [4, 6, 8], "rate": [0.01, 0.0387, 0.15], "l2": [1.0, 3.0, 6.0, 10.0]}


@register(QUERIES, "fit_baselines")
def fit_baselines(spark, sf_dir):
    train, _, test = modelling(spark, sf_dir)
    models = {k: v for k, v in suite(train.count()).items() if k != "boosted"}
    return M.benchmark({"test": (train, test)}, models).drop("latency_ms")


@register(QUERIES, "fit_boosted")
def fit_boosted(spark, sf_dir):
    train, _, test = modelling(spark, sf_dir)
    return M.benchmark({"test": (train, test)}, {"boosted": M.boosted(**BOOST)}).drop("latency_ms")


@register(QUERIES, "bench_models")
def bench_models(spark, sf_dir):
    train, val, _ = modelling(spark, sf_dir)
    part = lambda df, i: df.where(F.col("event_id") % 2 == i)
    data = {f"d{i}": (part(train, i), part(val, i)) for i in range(2)}
    return M.compared(M.benchmark(data, contenders(train.count() // 2)), ["pr_auc", "latency_ms"])


@register(QUERIES, "tune_grid")
def tune_grid(spark, sf_dir):
    train, val, _ = modelling(spark, sf_dir)
    return M.tune(train, val, SPACE, lambda depth, rate, l2: M.boosted(250, depth, rate, 1.0, growth="symmetric", l2=l2))


@register(QUERIES, "fit_calibration")
def fit_calibration(spark, sf_dir):
    """Calibration of the ``scored`` view: halves by time, both methods and no calibration."""
    df = E.split_temporal(scored(spark, sf_dir), train=0.5, val=0.25)
    first, second = df.where("split = 'train'"), df.where("split <> 'train'")
    return M.choose_calibration(first.select("p", "label"), second.select("p", "label"))[1]


@register(QUERIES, "score_model")
def score_model(spark, sf_dir):
    train, val, test = modelling(spark, sf_dir)
    model = M.logistic(train.count()).fit(train)
    calibration = M.fit_calibration(M.probabilities(model, val), "platt")
    return M.score_model(model, calibration, test).select("transaction_id", "p", "calibrated", "ml_decision")


def _anomaly(spark, sf_dir):
    tx = cut_lineage(P.features_32(transactions(spark, sf_dir, 300)))
    return tx, M.fit_isolation_forest(tx.where("is_fraud = 0"), FEATURES)


@register(QUERIES, "fit_anomaly")
def fit_anomaly(spark, sf_dir):
    _, model = _anomaly(spark, sf_dir)
    rows = [(i, len(t["left"]), int((t["left"] < 0).sum()), float(model.offset)) for i, t in enumerate(model.trees)]
    return spark.createDataFrame(rows, "tree int, nodes int, leaves int, offset double")


@register(QUERIES, "score_anomaly")
def score_anomaly(spark, sf_dir):
    tx, model = _anomaly(spark, sf_dir)
    return model.risk(tx).select("transaction_id", "is_fraud", "anomaly_risk")


@register(QUERIES, "imb_oversample_pairs")
def imb_oversample_pairs(spark, sf_dir):
    df = transactions(spark, sf_dir).selectExpr(
        "transaction_id", "cast(amount as double) as amount", "origin_balance", "cast(k as double) as k", "is_fraud as label")
    return M.oversample_pairs(df, ["amount", "origin_balance", "k"])


@register(QUERIES, "challenger_udf")
def challenger_udf(spark, sf_dir):
    """A user's scoring function over Arrow batches; errors become null scores."""
    out = P.features_32(transactions(spark, sf_dir, 300))
    at = FEATURES.index("amount_to_balance_ratio")
    return M.isolated_scores(out, lambda x: 1.0 / (1.0 + x[:, at])).withColumn("p", rnd(F.col("p"), 6))
