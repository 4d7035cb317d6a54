"""Labels, replay, accounting and telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskspark.constants import COMPONENTS, DAY, END_TO_END, ERROR_TYPES, LATENCY_BUCKETS, STAGE_BUCKETS
from riskspark.functions.scalar import rnd
from riskspark.operators.distsort import join_null_safe, quantiles

LABEL_DELAY = 14 * DAY


def mature_labels(labels: DataFrame, as_of_us: int) -> DataFrame:
    """A label counts once it was reported; the rest is pending."""
    return labels.withColumn("state", F.when(F.col("reported_us") <= as_of_us, "matured").otherwise("pending"))


def replay(tx: DataFrame, score, cap: int | None = None, order: str = "us", tie: str = "transaction_id") -> DataFrame:
    """All events in time order, or only the first ``cap``, scored by ``score`` (frame to frame)."""
    ordered = tx.orderBy(order, tie)
    return score(ordered if cap is None else ordered.limit(cap))


def scenario_summary(replayed: DataFrame) -> DataFrame:
    is_ = lambda d: F.sum((F.col("decision") == d).cast("int"))
    return replayed.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("fraud"), is_("BLOCK").alias("blocked"),
        is_("REVIEW").alias("reviewed"), is_("APPROVE").alias("approved"))


def reconcile(log: DataFrame, key: str) -> DataFrame:
    """Message accounting; an id is settled once, by its strongest status."""
    rank = lambda s: F.max((F.col("status") == s).cast("int"))
    per = log.groupBy(key).agg(F.count(F.lit(1)).alias("copies"), *[
        rank(s).alias(s) for s in ("processed", "failed", "dlq", "pending")])
    state = (F.when(F.col("processed") == 1, "processed").when(F.col("failed") == 1, "failed")
             .when(F.col("dlq") == 1, "dlq").when(F.col("pending") == 1, "pending").otherwise("lost"))
    per = per.select("copies", state.alias("state"))
    c = lambda s: F.sum((F.col("state") == s).cast("bigint"))
    n = F.count(F.lit(1))
    out = per.agg(F.sum("copies").alias("total_input"), n.alias("unique_input"), (F.sum("copies") - n).alias("duplicates"),
                  *[c(s).alias(s) for s in ("processed", "failed", "dlq", "pending", "lost")])
    return out.withColumns({"is_balanced": F.col("lost") == 0,
                            "loss_percent": rnd(F.col("lost") * 100.0 / F.greatest(F.lit(1), F.col("unique_input")), 4)})


def latency_summary(df: DataFrame, exact: bool = True) -> DataFrame:
    """Mean, exact percentiles, range and count per stage; ``exact=False`` uses sketches."""
    v = F.col("latency").cast("double")
    basic = df.groupBy("stage").agg(
        rnd(F.sum("latency").cast("double") / F.count(F.lit(1)), 3).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.count(F.lit(1)).alias("count"),
        *([] if exact else [F.percentile_approx(v, q, 10000).alias(n) for n, q in (("p50", .5), ("p95", .95), ("p99", .99))]))
    if not exact:
        return basic
    q = quantiles(df.select("stage", v.alias("latency")), "latency", [0.5, 0.95, 0.99], ["stage"])
    at = lambda p, n: rnd(F.max(F.when(F.col("prob") == p, F.col("value"))), 3).alias(n)
    return join_null_safe(basic, q.groupBy("stage").agg(at(0.5, "p50"), at(0.95, "p95"), at(0.99, "p99")), ["stage"])


def bucket_of(value: Column, bounds: list[float] = LATENCY_BUCKETS) -> Column:
    """Upper bound of the histogram bucket, infinite above the last one."""
    out = F.when(value <= bounds[0], F.lit(str(bounds[0])))
    for b in bounds[1:]:
        out = out.when(value <= b, F.lit(str(b)))
    return out.otherwise(F.lit("+Inf"))


def latency_histogram(df: DataFrame) -> DataFrame:
    """End-to-end latency has its own bounds; every other stage the finer ones."""
    v = F.greatest(F.lit(0.0), F.col("latency").cast("double"))
    bucket = F.when(F.col("stage") == END_TO_END, bucket_of(v)).otherwise(bucket_of(v, STAGE_BUCKETS))
    return df.groupBy("stage", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def lag_trend(samples: DataFrame, group: str = "partition") -> DataFrame:
    at = F.struct("us", "event_id")
    out = samples.groupBy(group).agg(
        F.min_by("lag", at).alias("initial_lag"), F.max("lag").alias("max_lag"), F.max_by("lag", at).alias("final_lag"),
        F.count(F.lit(1)).alias("samples"))
    first, last, top = F.col("initial_lag"), F.col("final_lag"), F.col("max_lag")
    trend = F.when((last > first) & (last > 10), "growing").when((last < top) & (last <= 2), "drained_to_baseline").otherwise("stable")
    return out.withColumn("trend", trend)


def error_counters(errors: DataFrame) -> DataFrame:
    """Errors by component and type; unknown labels fold into one."""
    c, e = F.lower("component"), F.lower("error_type")
    return errors.groupBy(
        F.when(c.isin(COMPONENTS), c).otherwise("internal_error").alias("component"),
        F.when(e.isin(ERROR_TYPES), e).otherwise("runtime_error").alias("error_type")).agg(F.count(F.lit(1)).alias("n"))
