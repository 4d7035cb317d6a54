"""Model fitting and scoring on MLlib, and an isolation forest grown from bounded samples."""

from __future__ import annotations

import itertools
import math
import time
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window, functions as F

from riskspark.constants import FEATURES
from riskspark.operators import evaluate as E
from riskspark.operators.boosting import Boosting, fit_together
from riskspark.operators.distsort import global_row_number
from riskspark.operators.fusion import ml_decision
from riskspark.session import cut_lineage

EPS = 1e-6


def assembled(df: DataFrame, features: list[str] = FEATURES, label: str = "is_fraud") -> DataFrame:
    """Feature vector, label and balanced weight."""
    counts = df.groupBy(label).count().collect()  # two rows
    n = sum(r["count"] for r in counts)
    weight = F.lit(1.0)
    for r in counts:
        weight = F.when(F.col(label) == r[label], n / (len(counts) * r["count"])).otherwise(weight)
    numeric = df.withColumns({f: F.col(f).cast("double") for f in features})
    out = VectorAssembler(inputCols=features, outputCol="x", handleInvalid="error").transform(numeric)
    return out.withColumn("label", F.col(label).cast("double")).withColumn("weight", weight)


def logistic(n_rows: int, c: float = 1.0, iterations: int = 100) -> Pipeline:
    """Scaled L2 logistic regression; the penalty per row is 1 / (c n)."""
    return Pipeline(stages=[
        StandardScaler(inputCol="x", outputCol="xs", withMean=True, withStd=True),
        LogisticRegression(featuresCol="xs", weightCol="weight", regParam=1.0 / (c * n_rows),
                           elasticNetParam=0.0, maxIter=iterations, standardization=False)])


def forest(trees: int = 200, depth: int = 12, seed: int = 42) -> Pipeline:
    return Pipeline(stages=[RandomForestClassifier(
        featuresCol="x", weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=5, seed=seed)])


def boosted(rounds: int = 300, depth: int = 6, rate: float = 0.05, subsample: float = 0.8, seed: int = 42,
            growth: str | None = None, **more) -> Pipeline | Boosting:
    """MLlib's boosted trees; with ``growth`` (and ``more`` of its settings) second-order trees on binned rows."""
    if growth is not None:
        return Boosting(rounds, depth, rate, subsample, growth=growth, seed=seed, **more)
    return Pipeline(stages=[GBTClassifier(
        featuresCol="x", weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=rate,
        subsamplingRate=subsample, seed=seed)])


def probabilities(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds ``p``, the probability of fraud."""
    return model.transform(df).withColumn("p", vector_to_array("probability")[1])


def evaluated(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row with ranking, threshold and probability metrics; every row is scored once."""
    return _metrics(cut_lineage(scored.select("label", "p")), threshold)


def _metrics(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    one = E.ranking_metrics(E.curve(scored))
    two = E.confusion(scored, threshold).select("precision", "recall", "f1", "fpr", "fnr")
    three = E.brier(scored)
    row = {**one.first().asDict(), **two.first().asDict(), **three.first().asDict()}
    return scored.sparkSession.createDataFrame([row])


def benchmark(data: dict[str, tuple[DataFrame, DataFrame]], models: dict[str, Pipeline]) -> DataFrame:
    """Metric row per (dataset, model): fit on the first frame, judged on the second; ``latency_ms`` is the time to score a row."""
    out = None
    for (dataset, (train, val)), (name, pipeline) in itertools.product(data.items(), models.items()):
        t0 = time.perf_counter()
        model = pipeline.fit(train)
        fit_s = time.perf_counter() - t0
        t0 = time.perf_counter()
        scored = cut_lineage(probabilities(model, val).select("label", "p"))
        infer_ms = (time.perf_counter() - t0) * 1000.0 / max(scored.count(), 1)
        row = _metrics(scored).withColumns({
            "dataset": F.lit(dataset), "model": F.lit(name), "fit_time_sec": F.lit(round(fit_s, 2)), "latency_ms": F.lit(round(infer_ms, 6))})
        out = row if out is None else out.unionByName(row)
    return out


def compared(rows: DataFrame, measures: list[str]) -> DataFrame:
    """Metric rows with each measure of their model on every dataset, and its mean over the datasets."""
    for m in measures:
        wide = rows.groupBy("model").pivot("dataset").agg(F.first(m))
        wide = wide.toDF("model", *[f"{m}_{d}" for d in wide.columns[1:]])
        mean = rows.groupBy("model").agg(F.avg(m).alias(f"mean_{m}"))
        rows = rows.join(F.broadcast(wide), "model").join(F.broadcast(mean), "model")
    return rows


def tune(train: DataFrame, val: DataFrame, grid: dict[str, list], build) -> DataFrame:
    """Validation PR-AUC of every point of a grid; the test split is not an argument."""
    points = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    builds, rows = [build(**params) for params in points], []
    together = all(isinstance(b, Boosting) for b in builds)
    for params, model in zip(points, fit_together(builds, train) if together else (b.fit(train) for b in builds)):
        rows.append({**params, **E.ranking_metrics(E.curve(probabilities(model, val))).first().asDict()})
    best = max(rows, key=lambda r: (r["pr_auc"], r["roc_auc"]))
    return train.sparkSession.createDataFrame([{**r, "best": r is best} for r in rows])


# --- imbalance -------------------------------------------------------------------------

def oversample_pairs(df: DataFrame, features: list[str], label: str = "label", key: str = "transaction_id",
                     limit: int | None = None, seed: int = 42) -> DataFrame:
    """All rows and two synthetic positives per positive, each between two hash-chosen positives.

    ``limit`` (none unless given) bounds the synthetic rows. Draws are md5 of seed, draw and
    number, so that they are the same on every engine.
    """
    pos = global_row_number(df.where(F.col(label) == 1).select(key, *features), [F.col(key)])
    pos = pos.select(F.col("rn"), F.struct(*features).alias("v"))
    n = df.where(F.col(label) == 1).count()
    if n < 2:
        return df.select(*features, label)
    hashed = lambda s: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit(s), F.col("id"))), 1, 8), 16, 10).cast("bigint")
    draw = lambda s: hashed(s) % n + 1
    lam = F.lit(0.1) + hashed(3) % 1_000_000 / F.lit(1_250_000.0)
    want = df.sparkSession.range(2 * n if limit is None else min(2 * n, limit)).select(
        "id", draw(1).alias("i"), draw(2).alias("j"), lam.alias("lam"))
    a = want.join(pos, F.col("i") == F.col("rn")).select("id", "j", "lam", F.col("v").alias("a"))
    b = a.join(pos, F.col("j") == F.col("rn")).select("lam", "a", F.col("v").alias("b"))
    mixed = [(F.col(f"a.{f}") + F.col("lam") * (F.col(f"b.{f}") - F.col(f"a.{f}"))).alias(f) for f in features]
    return df.select(*features, label).unionByName(b.select(*mixed, F.lit(1).alias(label)))


# --- isolation forest ------------------------------------------------------------------

@dataclass
class IsolationForest:
    """Trees as flat arrays; a tree has at most 2 * sample - 1 nodes, so the model is small."""

    features: list[str]
    trees: list[dict[str, np.ndarray]]
    sample: int
    offset: float = -0.5

    def raw_score(self, df: DataFrame, name: str = "iso_score") -> DataFrame:
        """Minus 2 to the power of minus mean path length over its expectation."""
        shared = df.sparkSession.sparkContext.broadcast(self.trees)
        norm = _expected_path(self.sample)

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            rows = np.stack(x.to_numpy()).astype(np.float64) if len(x) else np.zeros((0, 1))
            depth = np.zeros(len(rows))
            for tree in shared.value:
                at = np.zeros(len(rows), dtype=np.int64)
                live = tree["left"][at] >= 0
                while live.any():
                    i = np.flatnonzero(live)
                    n = at[i]
                    go = rows[i, tree["feature"][n]] < tree["cut"][n]
                    at[i] = np.where(go, tree["left"][n], tree["right"][n])
                    live[i] = tree["left"][at[i]] >= 0
                depth += tree["length"][at]
            return pd.Series(-np.power(2.0, -depth / len(shared.value) / norm))
        return df.withColumn(name, score(F.array(*[F.col(f).cast("double") for f in self.features])))

    def risk(self, df: DataFrame, name: str = "anomaly_risk") -> DataFrame:
        out = self.raw_score(df, "_iso")
        x = F.col("_iso") - F.lit(self.offset)
        return out.withColumn(name, F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(10.0) * x))).drop("_iso")


def _expected_path(n: float) -> float:
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def grow_tree(x: np.ndarray, seed: int, limit: int) -> list[tuple]:
    """Nodes (feature, cut, left, right, length) of one random tree; a leaf has left -1."""
    rng, nodes, todo = np.random.default_rng(seed), [], [(np.arange(len(x)), 0, -1, "")]
    while todo:
        rows, depth, parent, side = todo.pop()
        at = len(nodes)
        if parent >= 0:
            nodes[parent][2 if side == "l" else 3] = at
        part = x[rows]
        low, high = (part.min(0), part.max(0)) if len(rows) else (np.zeros(1), np.zeros(1))
        open_ = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(open_):
            nodes.append([-1, 0.0, -1, -1, depth + _expected_path(len(rows))])
            continue
        f = int(rng.choice(open_))
        cut = float(rng.uniform(low[f], high[f]))
        go = part[:, f] < cut
        nodes.append([f, cut, -1, -1, 0.0])
        todo += [(rows[~go], depth + 1, at, "r"), (rows[go], depth + 1, at, "l")]
    return [tuple(n) for n in nodes]


def fit_isolation_forest(legit: DataFrame, features: list[str] = FEATURES, trees: int = 150, sample: int = 256,
                         contamination: float = 0.01, key: str = "transaction_id", seed: int = 42) -> IsolationForest:
    """Bags are drawn by hash in one pass and trimmed to ``sample`` rows; each tree grows in
    its own task. Draws per row are spread so that about 1.5 bags' worth of rows leave the scan."""
    n = legit.count()
    rate = trees * sample * 1.5 / max(n, 1)
    whole, part = int(rate), rate - int(rate)
    h = lambda *x: F.xxhash64(F.lit(seed), *x)
    unit = F.pmod(h(F.col(key), F.lit("part")), F.lit(1_000_000)) / F.lit(1_000_000.0)
    draws = F.lit(whole) + F.when(unit < part, 1).otherwise(0)
    narrow = legit.select(key, F.array(*[F.col(f).cast("double") for f in features]).alias("v"))
    bags = narrow.where(draws > 0).withColumn("_d", F.explode(F.sequence(F.lit(1), draws)))
    bags = bags.withColumn("tree", F.pmod(h(F.col(key), F.col("_d")), F.lit(trees))).dropDuplicates(["tree", key])
    order = Window.partitionBy("tree").orderBy(h(F.col("tree"), F.col(key)))
    bags = bags.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= sample).select("tree", "v")
    limit = max(1, math.ceil(math.log2(max(2, min(sample, n)))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf.tree.iloc[0])
        nodes = grow_tree(np.array(pdf.v.tolist(), dtype=np.float64), seed * 1_000_003 + t, limit)
        out = pd.DataFrame(nodes, columns=["feature", "cut", "left", "right", "length"])
        return out.assign(tree=t, node=range(len(out)))

    grown = bags.groupBy("tree").applyInPandas(
        grow, "feature int, cut double, left int, right int, length double, tree int, node int")
    table = grown.toPandas().sort_values(["tree", "node"])  # bounded by trees * (2 * sample - 1) nodes
    flat = [{c: g[c].to_numpy() for c in ("feature", "cut", "left", "right", "length")} for _, g in table.groupby("tree")]
    model = IsolationForest(features, flat, min(sample, n))
    scored = model.raw_score(legit.select(*dict.fromkeys([key, *features])))
    model.offset = scored.agg(F.percentile_approx("iso_score", contamination, 100_000)).first()[0]
    return model


# --- calibration -----------------------------------------------------------------------

@dataclass
class Calibration:
    method: str
    model: object

    def apply(self, df: DataFrame, raw: str = "p", name: str = "calibrated") -> DataFrame:
        p = _clipped(F.col(raw))
        if self.method == "platt":
            w, b = float(self.model.coefficients[0]), float(self.model.intercept)
            value = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.log(p / (F.lit(1.0) - p)) * F.lit(w) + F.lit(b))))
            return df.withColumn(name, value)
        out = self.model.transform(df.withColumn("_p", p))
        return out.withColumn(name, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_iso")))).drop("_p", "_iso")


def _clipped(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(EPS)), F.lit(1.0 - EPS))


def fit_calibration(scored: DataFrame, method: str, raw: str = "p", label: str = "label", digits: int | None = None) -> Calibration:
    """Platt (logistic on the logit) or isotonic, on weighted distinct scores.

    ``digits`` rounds the scores first; none unless given. Isotonic regression pools all distinct
    points on the driver in its last step, so give it 6 digits (a million points) on a large table.
    """
    grid = _clipped(F.col(raw)) if digits is None else F.round(_clipped(F.col(raw)), digits)
    points = scored.groupBy(_clipped(grid).alias("_p"), F.col(label).cast("double").alias("label")).agg(
        F.count(F.lit(1)).cast("double").alias("w"))
    if method == "isotonic":
        model = IsotonicRegression(featuresCol="_p", labelCol="label", weightCol="w", predictionCol="_iso").fit(points)
        return Calibration(method, model)
    n = scored.count()
    logit = points.withColumn("_l", F.log(F.col("_p") / (F.lit(1.0) - F.col("_p"))))
    x = VectorAssembler(inputCols=["_l"], outputCol="x").transform(logit)
    return Calibration(method, LogisticRegression(
        featuresCol="x", weightCol="w", regParam=1.0 / n, standardization=False, maxIter=100).fit(x))


def choose_calibration(fit_on: DataFrame, judge_on: DataFrame) -> tuple[Calibration, DataFrame]:
    """Fit both on one half, keep the lower Brier score on the other, refit on all; the report
    also has the uncalibrated scores."""
    brier = lambda df, c: df.agg(F.avg(F.pow(F.col(c) - F.col("label"), 2))).first()[0]
    report = {"raw": brier(judge_on, "p")}
    for method in ("isotonic", "platt"):
        report[method] = brier(fit_calibration(fit_on, method).apply(judge_on), "calibrated")
    best = "isotonic" if report["isotonic"] <= report["platt"] else "platt"
    table = fit_on.sparkSession.createDataFrame(
        [(m, round(float(b), 6), m == best) for m, b in report.items()], "method string, brier_score double, chosen boolean")
    return fit_calibration(fit_on.unionByName(judge_on), best), table


def score_model(model: PipelineModel, calibration: Calibration, df: DataFrame) -> DataFrame:
    """Raw and calibrated probability and the model's own decision; invalid ones have none."""
    out = calibration.apply(probabilities(model, df))
    return out.withColumn("ml_decision", ml_decision(F.col("calibrated")))


def isolated_scores(df: DataFrame, predict, features: list[str] = FEATURES) -> DataFrame:
    """A user's model (array in, array out) over Arrow batches; a failing batch scores null."""
    schema = df.select("transaction_id").schema.add("p", "double").add("error", "string")

    def run(batches):
        for pdf in batches:
            out = pdf[["transaction_id"]].copy()
            try:
                out["p"], out["error"] = np.asarray(predict(pdf[features].to_numpy(dtype=float))), None
            except Exception as ex:  # the challenger must never stop production
                out["p"], out["error"] = np.nan, type(ex).__name__
            yield out
    return df.select("transaction_id", *[F.col(f).cast("double").alias(f) for f in features]).mapInPandas(run, schema)
