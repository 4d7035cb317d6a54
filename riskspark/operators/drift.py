"""Population stability between a reference and a current table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskspark.functions.scalar import rnd
from riskspark.operators.distsort import quantiles
from riskspark.session import cut_lineage

MIN_ROWS = 50
SMOOTHING = 1e-4


def _long(df: DataFrame, features: list[str]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])
    out = df.select(F.explode(rows).alias("r")).select("r.feature", "r.x")
    return out.where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") != float("inf")))


def psi(reference: DataFrame, current: DataFrame, features: list[str], bins: int = 10) -> DataFrame:
    """PSI per feature with its bins.

    Edges are exact reference quantiles from distributed order statistics; values outside
    them fall in no bin but stay in the denominator. Equal values are combined before any
    shuffle.
    """
    both = _long(reference, features).withColumn("side", F.lit("ref")).unionByName(
        _long(current, features).withColumn("side", F.lit("cur")))
    counts = cut_lineage(both.groupBy("feature", "side", "x").agg(F.count(F.lit(1)).alias("n")))
    size = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("n"))), F.lit(0))
    facts = counts.groupBy("feature").agg(size("ref").alias("n_ref"), size("cur").alias("n_cur"),
                                          F.min("x").alias("lo"), F.max("x").alias("hi"))
    probs = [i / bins for i in range(bins + 1)]
    ref = _long(reference, features)
    q = quantiles(ref, "x", probs, ["feature"]).groupBy("feature").agg(
        F.array_sort(F.collect_set("value")).alias("q"))  # at most bins + 1 values
    width = (F.col("hi") - F.col("lo")) / bins
    even = F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: F.when(i == bins, F.col("hi")).otherwise(F.col("lo") + i * width))
    edges = cut_lineage(facts.join(q, "feature").withColumn(
        "edges", F.when(F.size("q") >= 3, F.col("q")).when(F.col("lo") == F.col("hi"), F.array().cast("array<double>")).otherwise(even))
        .drop("q", "lo", "hi"))
    side = F.broadcast(edges)  # one row per feature name
    x, e = F.col("x"), F.col("edges")
    last = F.size(e) - 1
    at = F.size(F.filter(e, lambda b: b <= x))
    bin_ = F.when(x == F.element_at(e, -1), last - 1).otherwise(at - 1)
    inside = (F.size(e) > 0) & (x >= F.get(e, F.lit(0))) & (x <= F.element_at(e, -1))
    hits = counts.join(side, "feature").where(inside).groupBy("feature", bin_.alias("bin")).agg(
        size("ref").alias("ref"), size("cur").alias("cur"))
    grid = edges.where((F.size("edges") > 0) & (F.col("n_ref") >= MIN_ROWS) & (F.col("n_cur") >= MIN_ROWS)).select(
        "feature", "n_ref", "n_cur", "edges", F.explode(F.sequence(F.lit(0), F.size("edges") - 2)).alias("bin"))
    cells = grid.join(hits, ["feature", "bin"], "left")
    a = F.coalesce("cur", F.lit(0)) / F.col("n_cur") + F.lit(SMOOTHING)
    b = F.coalesce("ref", F.lit(0)) / F.col("n_ref") + F.lit(SMOOTHING)
    cells = cells.withColumn("bin_psi", (a - b) * F.log(a / b))
    cell = F.struct("bin", F.get("edges", F.col("bin")).alias("lower"), F.get("edges", F.col("bin") + 1).alias("upper"),
                    rnd(b, 4).alias("expected"), rnd(a, 4).alias("actual"), F.col("bin_psi").alias("bin_psi"))
    per = cells.groupBy("feature").agg(F.sum("bin_psi").alias("_psi"), F.array_sort(F.collect_list(cell)).alias("bins"))
    out = edges.select("feature", "n_ref", "n_cur").join(per, "feature", "left")
    value = rnd(F.greatest(F.coalesce("_psi", F.lit(0.0)), F.lit(0.0)), 4)
    return out.withColumn("psi", value).withColumn("severity", severity("psi")).drop("_psi")


def severity(psi_col: str):
    return F.when(F.col(psi_col) >= 0.25, "SIGNIFICANT_DRIFT").when(F.col(psi_col) >= 0.10, "MODERATE_DRIFT").otherwise("STABLE")


def assess(report: DataFrame) -> DataFrame:
    """Overall status of a drift report (one row per feature)."""
    out = report.agg(
        F.max("psi").alias("max_psi"), rnd(F.avg("psi"), 4).alias("mean_psi"), F.count(F.lit(1)).alias("features"),
        F.sum((F.col("severity") == "SIGNIFICANT_DRIFT").cast("int")).alias("drifting"))
    bad = (F.col("max_psi") >= 0.25) | ((F.col("features") >= 5) & (F.col("mean_psi") >= 0.15))
    return out.withColumn("status", F.when(bad, "SIGNIFICANT_DRIFT").when(F.col("max_psi") >= 0.10, "MODERATE_DRIFT")
                          .otherwise("STABLE"))
