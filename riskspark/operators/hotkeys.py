"""Three densities of keys, told apart by one count of the key columns.

Light keys (up to ``light_rows`` rows) use ordinary sliding frames. Busy keys use running
totals of arrivals and departures, which stay linear however long a window gets. A key with
more rows than ``hot_rows`` is also cut into segments at its own time quantiles, so that no
window has to hold it in one task; each segment starts from the totals of the earlier ones.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskspark.session import cut_lineage

LIGHT_ROWS = 2_000
HOT_ROWS = 5_000_000
CUTS = 1024
BROADCAST_HOT_KEYS = 5_000
BROADCAST_BUSY_KEYS = 500_000


@dataclass(frozen=True)
class Limits:
    """Row counts at which a key stops being light, and from which it is hot."""

    light: int = LIGHT_ROWS
    hot: int = HOT_ROWS


DEFAULT = Limits()


@dataclass
class HotKeys:
    """The hot keys of a table with their time cuts; ``table`` is None when there are none."""

    key: str
    table: DataFrame | None

    def segmented(self, df: DataFrame, us: str = "us") -> DataFrame:
        if self.table is None:
            return df.withColumn("_seg", F.lit(-1))
        hot = self.table.withColumnRenamed(self.key, "_hot_key")
        out = df.join(hot, F.col(self.key).cast("string") == F.col("_hot_key"), "left")
        seg = F.when(F.col("_cuts").isNull(), F.lit(-1)).otherwise(_bisect("_cuts", us))
        return out.withColumn("_seg", seg).drop("_hot_key", "_cuts")


def _bisect(cuts: str, us: str) -> Column:
    """Number of cuts at or before ``us``: binary search inside one higher-order function."""
    return F.expr(
        f"aggregate(array(1024, 512, 256, 128, 64, 32, 16, 8, 4, 2, 1), 0,"
        f" (i, step) -> if(coalesce(get({cuts}, i + step - 1) <= {us}, false), i + step, i))"
    )


@dataclass
class Census:
    """Row counts ``(_kind, _key, _n)`` and, per kind, how many keys are busy and hot."""

    table: DataFrame
    busy: dict[str, int]
    hot: dict[str, int]
    rows: dict[str, int]

    def of(self, kind: str, above: int = 0) -> DataFrame:
        return self.table.where((F.col("_kind") == kind) & (F.col("_n") > above)).select(
            F.col("_key").alias(kind), "_n")


def census(df: DataFrame, keys: dict[str, Column], whole: dict[str, Column] | None = None,
           limits: Limits = DEFAULT) -> Census:
    """Row counts of several key columns in one scan.

    ``keys`` keep only the values that are not light; ``whole`` lists low-cardinality columns
    whose counts are all kept. The result is materialised and its size measured.
    """
    wanted = {**keys, **(whole or {})}
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), c.cast("string").alias("v"))
                      for k, c in wanted.items()])
    counted = (
        df.select(F.explode(pairs).alias("_p"))
        .groupBy(F.col("_p.k").alias("_kind"), F.col("_p.v").alias("_key"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    kept = (F.col("_n") > limits.light) & F.col("_key").isNotNull()
    if whole:
        kept = kept | F.col("_kind").isin(*whole)
    table = cut_lineage(counted.where(kept))
    sizes = table.groupBy("_kind").agg(  # one row per kind
        F.count(F.lit(1)).alias("busy"), F.count_if(F.col("_n") > limits.hot).alias("hot"),
        F.sum("_n").alias("rows")).collect()
    return Census(table, {r._kind: r.busy for r in sizes}, {r._kind: r.hot for r in sizes},
                  {r._kind: r.rows for r in sizes})


def find_hot(df: DataFrame, key: str, points: DataFrame, at: str = "at",
             limits: Limits = DEFAULT, counted: Census | None = None) -> HotKeys:
    """The hot values of ``key`` and their time cuts, which are only computed for them.

    ``points`` holds what the window will read (arrivals and departures); the cuts follow its
    time distribution. ``counted`` is a census taken earlier.
    """
    if counted is None:
        counted = census(df, {key: F.col(key)}, limits=limits)
    n_hot = counted.hot.get(key, 0)
    if n_hot == 0:
        return HotKeys(key, None)
    names = counted.of(key, limits.hot)
    side = F.broadcast(names) if n_hot <= BROADCAST_HOT_KEYS else names
    narrow = points.select(F.col(key).cast("string").alias(key), F.col(at).alias("_us"))
    probs = [i / CUTS for i in range(1, CUTS)]
    cuts = (
        narrow.join(side, key)
        .groupBy(key)
        .agg(F.percentile_approx("_us", probs, 20 * CUTS).alias("_q"), F.max("_n").alias("_n"))
        # a key just above the limit needs few segments: keep every stride-th quantile
        .withColumn("_stride", F.greatest(F.lit(1), F.floor(F.lit(CUTS * limits.hot) / F.col("_n"))))
        .select(key, F.expr("array_sort(array_distinct(filter(_q, (q, i) -> i % _stride = 0)))")
                .alias("_cuts"))
    )
    cuts = cut_lineage(cuts)
    return HotKeys(key, F.broadcast(cuts) if n_hot <= BROADCAST_HOT_KEYS else cuts)


def by_density(df: DataFrame, key: str, counted: Census,
               light: Callable[[DataFrame], DataFrame],
               busy: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Send light and busy keys to their own plan; when busy keys are many, all rows take the
    busy plan, which is right for any key."""
    n_busy = counted.busy.get(key, 0)
    if n_busy == 0:
        return light(df)
    if n_busy > BROADCAST_BUSY_KEYS:
        return busy(df)
    side = F.broadcast(counted.of(key).select(key))
    return light(df.join(side, key, "left_anti")).unionByName(
        busy(df.join(side, key, "left_semi")))


def before(
    df: DataFrame,
    keys: list[str],
    totals: dict[str, Column],
    latest: dict[str, Column],
    hot: HotKeys,
    us: str = "us",
    inclusive: bool = False,
    source: DataFrame | None = None,
) -> DataFrame:
    """Add, per row, sums (``totals``) and maxima (``latest``) over rows before its instant.

    ``df`` carries ``_seg`` from :meth:`HotKeys.segmented`. The frame always starts at the
    segment's first row, which Spark updates incrementally, so the cost is linear. Segments
    cut at an instant never separate rows of equal time. ``source`` is the frame to total
    the segments from, when ``df`` already went through other windows.
    """
    upper = 0 if inclusive else -1
    frame = Window.partitionBy(*keys, "_seg").orderBy(us).rangeBetween(
        Window.unboundedPreceding, upper)
    if hot.table is None:
        added = {n: F.coalesce(F.sum(c).over(frame), F.lit(0)) for n, c in totals.items()}
        added |= {n: F.max(c).over(frame) for n, c in latest.items()}
        return df.withColumns(added)

    carried = (
        (source or df).where("_seg >= 0").groupBy(*keys, "_seg")
        .agg(*[F.sum(c).alias(f"_c_{n}") for n, c in totals.items()],
             *[F.max(c).alias(f"_c_{n}") for n, c in latest.items()])
    )
    earlier = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select(
        *[F.col(k).alias(f"_k_{i}") for i, k in enumerate(keys)], F.col("_seg").alias("_k_seg"),
        *[F.sum(f"_c_{n}").over(earlier).alias(f"_c_{n}") for n in totals],
        *[F.max(f"_c_{n}").over(earlier).alias(f"_c_{n}") for n in latest],
    )
    inside = {f"_i_{n}": F.sum(c).over(frame) for n, c in totals.items()}
    inside |= {f"_i_{n}": F.max(c).over(frame) for n, c in latest.items()}
    on = F.col("_seg") == F.col("_k_seg")
    for i, k in enumerate(keys):
        on = on & (F.col(k) == F.col(f"_k_{i}"))
    joined = df.withColumns(inside).join(carried, on, "left")
    out = {n: F.coalesce(F.col(f"_i_{n}"), F.lit(0)) + F.coalesce(F.col(f"_c_{n}"), F.lit(0))
           for n in totals}
    out |= {n: F.greatest(F.col(f"_i_{n}"), F.col(f"_c_{n}")) for n in latest}
    drop = [f"_i_{n}" for n in (*totals, *latest)] + [f"_c_{n}" for n in (*totals, *latest)]
    drop += [f"_k_{i}" for i in range(len(keys))] + ["_k_seg"]
    return joined.withColumns(out).drop(*drop)

