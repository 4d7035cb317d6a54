"""Global order without a single task: row numbers, running totals, order statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskspark.session import broadcast_if_small, cut_lineage

PARTITION_BITS = 33
BROADCAST_OFFSETS = 1_000_000


def file_row_number(df: DataFrame, name: str = "row_number") -> DataFrame:
    """Position of each row in scan order, from 0; no shuffle of the rows.

    The count per input partition is one pruned pass; only those counts (one per partition)
    are accumulated.
    """
    tagged = df.withColumn("_mid", F.monotonically_increasing_id())
    part = F.shiftright("_mid", PARTITION_BITS)
    sizes = cut_lineage(tagged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size")))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    if sizes.count() <= BROADCAST_OFFSETS:
        offsets = F.broadcast(offsets)
    local = F.col("_mid").bitwiseAND((1 << PARTITION_BITS) - 1)
    return (
        tagged.withColumn("_part", part).join(offsets, "_part")
        .withColumn(name, F.col("_offset") + local).drop("_mid", "_part", "_offset")
    )


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join whose keys may be null on both sides; the left side's keys stay."""
    named = right.withColumnsRenamed({k: f"_null_safe_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(named[f"_null_safe_{k}"])
    return left.join(named, on, how).drop(*[f"_null_safe_{k}" for k in keys])


def running_totals(df: DataFrame, order: list[Column], totals: dict[str, Column],
                   group: list[str] | None = None) -> DataFrame:
    """Add inclusive running sums in ``order`` (unique within a group), per ``group``.

    Rows are range partitioned by group and order, so a large group is spread over many
    tasks. The partitioning is sampled, hence fixed by a checkpoint before it is used twice.
    Only one row per partition and group is accumulated globally.
    """
    group = group or []
    spread = df.repartitionByRange(*[F.col(g) for g in group], *order)
    fixed = cut_lineage(spread.withColumn("_pid", F.spark_partition_id()))
    keys = ["_pid", *group]
    sums = fixed.groupBy(*keys).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in totals.items()])
    over = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*keys, *[F.coalesce(F.sum(f"_t_{n}").over(over), F.lit(0)).alias(f"_t_{n}") for n in totals])
    local = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = join_null_safe(fixed.withColumns({n: F.sum(c).over(local) for n, c in totals.items()}), carried, keys)
    return out.withColumns({n: F.col(n) + F.col(f"_t_{n}") for n in totals}).drop(
        "_pid", *[f"_t_{n}" for n in totals])


def global_row_number(df: DataFrame, order: list[Column], name: str = "rn",
                      group: list[str] | None = None) -> DataFrame:
    """1-based position in a total order, optionally per group."""
    return running_totals(df, order, {name: F.lit(1)}, group)


def rank_threshold(df: DataFrame, column: str, rank: int, buckets: int = 4096) -> tuple[int, int]:
    """The value of an integer column at ``rank`` (from 0), and the rows below that value.

    The value range is narrowed by counting equal-width buckets: a few map-side-combined
    passes over one column, no sort and no shuffle of rows.
    """
    low, high = df.agg(F.min(column), F.max(column)).first()
    below = 0
    while low < high:
        width = max(1, -(-(high - low + 1) // buckets))
        counts = (
            df.where(F.col(column).between(low, high))
            .groupBy(F.expr(f"({column} - {low}L) div {width}L").alias("b")).agg(F.count(F.lit(1)).alias("n"))
        )
        for row in sorted(counts.collect(), key=lambda r: r.b):  # at most ``buckets`` rows
            if below + row.n > rank:
                low, high = low + row.b * width, min(high, low + (row.b + 1) * width - 1)
                break
            below += row.n
    return low, below


def order_statistics(df: DataFrame, value: str, ranks: DataFrame, group: list[str]) -> DataFrame:
    """Exact values at given ranks: ``ranks`` has the group columns and ``rank`` (from 0).

    Works on distinct values with their counts, so repeated values shrink first.
    """
    distinct = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_cnt"))
    run = running_totals(distinct, [F.col(value)], {"_upto": F.col("_cnt")}, group)
    return (
        join_null_safe(run, broadcast_if_small(ranks), group)
        .where((F.col("rank") < F.col("_upto")) & (F.col("rank") >= F.col("_upto") - F.col("_cnt")))
        .select(*group, "rank", F.col(value).alias("value"))
    )


def quantiles(df: DataFrame, value: str, probs: list[float], group: list[str]) -> DataFrame:
    """Exact linearly interpolated quantiles per group: group columns, ``prob``, ``value``."""
    sizes = cut_lineage(df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")))
    want = sizes.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs]))).withColumn(
        "_h", F.col("prob") * (F.col("_n") - 1)).withColumn("_lo", F.floor("_h"))
    want = want.withColumn("_hi", F.least(F.col("_lo") + 1, F.col("_n") - 1))
    ranks = want.select(*group, F.explode(F.array("_lo", "_hi")).alias("rank")).distinct()
    found = cut_lineage(order_statistics(df, value, ranks, group))  # two ranks per quantile
    at = lambda r, name: found.withColumnRenamed("rank", r).withColumnRenamed("value", name)
    out = join_null_safe(join_null_safe(want, at("_lo", "_a"), [*group, "_lo"]), at("_hi", "_b"), [*group, "_hi"])
    frac = F.col("_h") - F.col("_lo")
    return out.select(*group, "prob", (F.col("_a") + (F.col("_b") - F.col("_a")) * frac).alias("value"))
