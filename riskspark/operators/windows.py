"""Point-in-time windows.

For light keys the window ``[t - N, t)`` is the total before t less the total before t - N: both
frames only grow, so Spark adds every row once to each (a sliding frame adds up its whole window
again at every row). For busy keys every row arrives at its own time and
leaves a window of length N at time + N; the value of the window ``[t - N, t)`` is then the
running total of arrivals minus departures before t: one linear pass for any number of
horizons, however long the history is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from riskspark.constants import DAY, SECOND
from riskspark.functions import scalar as S
from riskspark.operators.hotkeys import DEFAULT, Census, Limits, before, by_density, census, find_hot
from riskspark.session import broadcast_if_small, cut_lineage

MONTH = 30 * DAY
HORIZONS = {"1m": 60 * SECOND, "5m": 300 * SECOND, "15m": 900 * SECOND, "1h": 3600 * SECOND,
            "30d": MONTH}
NEAR_KM = 50.0
CELL_DEG = 0.25


def sweep_points(df: DataFrame, horizons: dict[str, int], payload: list[str]) -> DataFrame:
    """One arrival and one departure per horizon; only the arrival keeps ``payload``."""
    steps = F.array(
        F.struct(F.lit("").alias("h"), F.col("us").alias("at")),
        *[F.struct(F.lit(h).alias("h"), (F.col("us") + F.lit(n)).alias("at"))
          for h, n in horizons.items()],
    )
    out = df.withColumn("_step", F.explode(steps))
    own = F.col("_step.h") == ""
    kept = [F.when(own, F.col(c)).alias(c) if c in payload else F.col(c)
            for c in df.columns if c != "us"]
    return out.select(*kept, F.when(own, F.col("us")).alias("us"),
                      F.col("_step.at").alias("at"), F.col("_step.h").alias("h"))


def inside(h: str, value: Column | int = 1) -> Column:
    """Contribution of a point to the window of horizon ``h``."""
    v = F.lit(value) if isinstance(value, int) else value
    return F.when(F.col("h") == "", v).when(F.col("h") == h, -v)


def arrivals(df: DataFrame) -> DataFrame:
    return df.where("h = ''").drop("h", "at", "_seg")


def _keyed(tx: DataFrame) -> DataFrame:
    return tx.withColumns({
        "_cents": (F.col("amount") * 100).cast("bigint"),
        "_hour": S.given(tx, "hour_of_day", S.hour_of(F.col("us"))),
        "_cat": F.lower(F.coalesce("category", F.lit(""))),
        "_dev": F.trim(F.coalesce("device_id", F.lit(""))),
    })


SHORT = {h: n for h, n in HORIZONS.items() if h != "30d"}
SUMMED = ("5m", "15m", "1h")


def _until(keys: list[str], n: int) -> WindowSpec:
    """The rows that are at least ``n`` older."""
    return Window.partitionBy(*keys).orderBy("us").rangeBetween(Window.unboundedPreceding, -n)


def _slide(total: Column, keys: list[str], n: int) -> Column:
    """A count or exact sum over ``[us - n, us)``; rows without time see each other."""
    before = F.coalesce(total.over(_until(keys, 1)), F.lit(0))
    left = F.coalesce(total.over(_until(keys, n + 1)), F.lit(0))
    return before - F.when(F.col("us").isNull(), F.lit(0)).otherwise(left)


def velocity(tx: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """Prior counts in 1/5/15/60 minutes and prior amounts in 5/15/60 minutes."""
    counted = census(tx, {"customer_id": F.col("customer_id")}, limits=limits)
    base = tx.withColumn("_cents", (F.col("amount") * 100).cast("bigint"))

    def busy(df: DataFrame) -> DataFrame:
        payload = [c for c in df.columns if c not in ("customer_id", "_cents")]
        points = sweep_points(df, SHORT, payload)
        hot = find_hot(df, "customer_id", points, limits=limits, counted=counted)
        totals = {f"tx_count_{h}": inside(h) for h in SHORT}
        totals |= {f"_cents_{h}": inside(h, F.col("_cents")) for h in SUMMED}
        return arrivals(before(hot.segmented(points, "at"), ["customer_id"], totals, {}, hot, us="at"))

    out = by_density(base, "customer_id", counted, lambda df: df.withColumns(_sliding("customer_id")), busy)
    return _money(out).drop("_cents")


def _sliding(scope: str) -> dict[str, Column]:
    out = {f"tx_count_{h}": _slide(F.count(F.lit(1)), [scope], n) for h, n in SHORT.items()}
    return out | {f"_cents_{h}": _slide(F.sum("_cents"), [scope], SHORT[h]) for h in SUMMED}


def _money(df: DataFrame) -> DataFrame:
    for h in SUMMED:
        df = df.withColumn(f"amount_sum_{h}", F.col(f"_cents_{h}") / F.lit(100.0)).drop(f"_cents_{h}")
    return df


def take_census(tx: DataFrame, limits: Limits = DEFAULT, scope: str = "customer_id") -> Census:
    """Busy customers, busy devices and all category counts in one scan."""
    lane = _lane(F.trim(F.coalesce("device_id", F.lit(""))), scope)
    return census(tx, {scope: F.col(scope), "_lane": lane},
                  {"category": F.coalesce("category", F.lit("None"))}, limits)


def _lane(device: Column, scope: str) -> Column:
    """Grouping key of a known device; null when there is no device."""
    lane = F.when(S.known_device(device), device)
    return lane if scope == "customer_id" else F.concat(F.col("split"), F.lit("\u0001"), lane)


def _squares() -> Column:
    return F.col("_cents").cast("decimal(12,0)") * F.col("_cents").cast("decimal(12,0)")


def _event() -> Column:
    return F.struct(F.col("us").alias("us"), F.col("transaction_id").alias("id"),
                    F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))


def history_windows(tx: DataFrame, limits: Limits = DEFAULT, scope: str = "customer_id",
                    counted: Census | None = None) -> DataFrame:
    """Every customer-keyed window in one exchange: velocity, 30-day behaviour, category
    share, known devices and the previous event.

    Adds raw moments (``_n``, ``_sum``, ``_squares``, ``_hours``, ``_same_cat``, ``_devices``,
    ``_same_dev``, ``_last``, ``_last_dev``, ``_first``) and the velocity features.
    """
    if counted is None:
        counted = take_census(tx, limits, scope)
    out = by_density(_keyed(tx), scope, counted, lambda df: _history_light(df, scope),
                     lambda df: _history_busy(df, scope, limits, counted))
    for name in ("_last", "_last_dev"):
        recent = F.col(f"{name}.us") >= F.col("us") - F.lit(MONTH)
        out = out.withColumn(name, F.when(recent, F.col(name)))
    return _money(out)


def _history_light(df: DataFrame, scope: str) -> DataFrame:
    rows = F.count(F.lit(1))
    past = lambda *keys: Window.partitionBy(*keys).orderBy("us").rangeBetween(
        Window.unboundedPreceding, -1)
    known = S.known_device(F.col("_dev")).cast("int")
    total = lambda c: _slide(F.sum(c), [scope], MONTH)
    tie = Window.partitionBy(scope, "_dev", "us").orderBy("transaction_id")
    df = df.withColumn("_known", known).withColumns(_sliding(scope) | {
        "_n": _slide(rows, [scope], MONTH), "_sum": total("_cents"), "_squares": total(_squares()).cast("decimal(35,0)"),
        "_hours": total("_hour"), "_devices": total("_known"),
        "_last": F.max(_event()).over(past(scope)),
    }).drop("_known")
    df = df.withColumn("_same_cat", _slide(rows, [scope, "_cat"], MONTH))
    df = df.withColumn("_first", F.row_number().over(tie) == 1)
    return df.withColumns({
        "_same_dev": _slide(rows, [scope, "_dev"], MONTH),
        "_last_dev": F.max(_event()).over(past(scope, "_dev")),
    })


def _history_busy(base: DataFrame, scope: str, limits: Limits, counted: Census) -> DataFrame:
    group = ["_cat", "_dev", "_cents", "_hour", scope]
    points = sweep_points(base, HORIZONS, [c for c in base.columns if c not in group])
    hot = find_hot(base, scope, points, limits=limits, counted=counted)
    points = hot.segmented(points, "at")
    cents = F.col("_cents")
    totals = {f"tx_count_{h}": inside(h) for h in SHORT}
    totals |= {f"_cents_{h}": inside(h, cents) for h in SUMMED}
    totals |= {
        "_n": inside("30d"), "_sum": inside("30d", cents), "_squares": inside("30d", _squares()),
        "_hours": inside("30d", F.col("_hour")),
        "_devices": inside("30d", S.known_device(F.col("_dev")).cast("int")),
    }
    event = F.when(F.col("h") == "", _event())
    out = before(points, [scope], totals, {"_last": event}, hot, us="at")
    out = before(out, [scope, "_cat"], {"_same_cat": inside("30d")}, {}, hot, us="at", source=points)
    # one of several uses of a device by a customer at the same instant stands for all
    tie = Window.partitionBy(scope, "_dev", "_seg", "at", "h").orderBy("transaction_id")
    out = out.withColumn("_first", F.row_number().over(tie) == 1)
    out = before(out, [scope, "_dev"], {"_same_dev": inside("30d")}, {"_last_dev": event}, hot,
                 us="at", source=points)
    return arrivals(out)


def behavior_columns(df: DataFrame) -> DataFrame:
    """30-day mean, spread, deviation, category share and hour deviation from the moments."""
    n, amount = F.col("_n"), F.col("amount").cast("double")
    mean = F.when(n > 0, F.col("_sum").cast("double") / n / F.lit(100.0)).otherwise(amount)
    std = S.sample_std(n, F.col("_sum"), F.col("_squares")) / F.lit(100.0)
    mean_cents = F.when(n > 0, F.floor((F.col("_sum") * 2 + n) / (n * 2))).otherwise(F.col("_cents"))
    share = F.when(n > 0, F.col("_same_cat").cast("double") / n).otherwise(F.lit(1.0))
    return df.withColumns({
        "user_avg_amount_30d": mean_cents / F.lit(100.0),
        "user_std_amount_30d": S.rnd(std, 2),
        "amount_zscore": S.rnd(S.zscore(amount, n, mean, std), 4),
        "user_category_frequency": S.rnd(share, 4),
        "user_hourly_tx_deviation": S.rnd(S.hour_deviation(F.col("_hour"), n, F.col("_hours")), 2),
    })


def mean_hour(df: DataFrame) -> DataFrame:
    """Mean hour of the prior 30 days; null without history."""
    n = F.col("_n")
    return df.withColumn("user_mean_hour_30d", F.when(n > 0, S.rnd(F.col("_hours").cast("double") / n, 4)))


def previous_event_columns(df: DataFrame) -> DataFrame:
    """Distance and speed from the last event of the same device, else of the customer."""
    last = F.when(S.known_device(F.col("_dev")), F.coalesce("_last_dev", "_last")).otherwise(F.col("_last"))
    lat, lon = F.col("latitude"), F.col("longitude")
    km = S.haversine_km(lat, lon, F.col("_prev.lat"), F.col("_prev.lon"))
    seconds = (F.col("us") - F.col("_prev.us")) / F.lit(1e6)
    return (
        df.withColumn("_prev", last)
        .withColumn("_km", F.coalesce(km, F.lit(0.0)))
        .withColumns({
            "distance_from_prev_loc_km": S.rnd(F.col("_km"), 2),
            "speed_kmh_from_prev_tx": S.rnd(
                F.coalesce(S.speed_kmh(F.col("_km"), seconds), F.lit(0.0)), 2),
        })
        .drop("_prev", "_km")
    )


def home_distance(df: DataFrame) -> DataFrame:
    lat, lon = F.col("latitude"), F.col("longitude")
    km = S.haversine_km(lat, lon, F.coalesce("home_latitude", lat), F.coalesce("home_longitude", lon))
    return df.withColumn("distance_from_home_km", S.rnd(km, 2))


def new_device_column(df: DataFrame) -> DataFrame:
    """A known device the customer has not used in 30 days, although others were used."""
    fresh = S.known_device(F.col("_dev")) & (F.col("_devices") > 0) & (F.col("_same_dev") == 0)
    return df.withColumn("is_new_device", fresh.cast("int"))


def _cell(degrees: Column) -> Column:
    return F.floor(degrees / F.lit(CELL_DEG)).cast("int")


def _month(us: Column) -> Column:
    return F.floor(us / F.lit(MONTH))


def new_location(tx: DataFrame, limits: Limits = DEFAULT, scope: str = "customer_id",
                 counted: Census | None = None) -> DataFrame:
    """Ids of located rows that are more than 50 km from every prior 30-day place.

    Places in one grid cell are always closer than 50 km, so a prior row in the same cell
    settles the question with a count. Only the rows that open a cell, at most one per cell
    and 30 days apart from ties, look into the neighbouring cells.
    """
    placed = cut_lineage(  # read twice below
        tx.where(S.has_place(F.col("latitude"), F.col("longitude")))
        .select("transaction_id", scope, "us", "latitude", "longitude",
                _cell(F.col("latitude")).alias("_row"), _cell(F.col("longitude")).alias("_col"))
    )
    if counted is None:
        counted = take_census(tx, limits, scope)

    def light(df: DataFrame) -> DataFrame:
        rows = F.count(F.lit(1))
        return df.withColumn("_prior", _slide(rows, [scope], MONTH)).withColumn(
            "_same", _slide(rows, [scope, "_row", "_col"], MONTH))

    def busy(df: DataFrame) -> DataFrame:
        raw = sweep_points(df, {"30d": MONTH}, ["transaction_id", "latitude", "longitude"])
        hot = find_hot(df, scope, raw, limits=limits, counted=counted)
        raw = hot.segmented(raw, "at")
        points = before(raw, [scope], {"_prior": inside("30d")}, {}, hot, us="at")
        return arrivals(before(points, [scope, "_row", "_col"], {"_same": inside("30d")}, {}, hot,
                               us="at", source=raw))

    opening = cut_lineage(by_density(placed, scope, counted, light, busy).where("_prior > 0 and _same = 0"))

    # 50 km is 0.45 degrees of latitude; a degree of longitude shrinks with the cosine
    reach = F.least(F.lit(720), F.ceil(
        F.lit(0.4501 / CELL_DEG) / F.greatest(
            F.cos(F.radians(F.least(F.lit(90.0), F.abs(F.col("latitude")) + F.lit(0.4501)))),
            F.lit(1e-4))) + 1).cast("int")
    wrap = int(360 / CELL_DEG)
    probes = (
        opening.select("transaction_id", scope, F.col("us").alias("_t"),
                       F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"),
                       "_row", "_col", reach.alias("_reach"))
        .withColumn("_row", F.explode(F.sequence(F.col("_row") - 3, F.col("_row") + 3)))
        .withColumn("_month", F.explode(F.array(_month(F.col("_t")), _month(F.col("_t")) - 1)))
        .withColumn("_col", F.explode(F.array_distinct(F.transform(
            F.sequence(F.col("_col") - F.col("_reach"), F.col("_col") + F.col("_reach")),
            lambda c: F.pmod(c, F.lit(wrap))))))
    )
    # a probe meets only its own 30 days and the ones before, not a hot customer's whole history
    places = placed.withColumns({"_col": F.pmod(F.col("_col"), F.lit(wrap)), "_month": _month(F.col("us"))})
    near = (
        probes.join(places.select(scope, "us", "latitude", "longitude", "_row", "_col", "_month"),
                    [scope, "_row", "_col", "_month"])
        .where("us < _t and us >= _t - %d" % MONTH)
        .where(S.haversine_km(F.col("_lat"), F.col("_lon"), F.col("latitude"), F.col("longitude"))
               <= NEAR_KM)
        .select("transaction_id").distinct()
    )
    return opening.select("transaction_id").join(near, "transaction_id", "left_anti")


def with_new_location(df: DataFrame, tx: DataFrame, limits: Limits = DEFAULT,
                      scope: str = "customer_id", counted: Census | None = None) -> DataFrame:
    flags = broadcast_if_small(
        new_location(tx, limits, scope, counted).withColumn("is_new_location", F.lit(1)))
    return df.join(flags, "transaction_id", "left").withColumn(
        "is_new_location", F.coalesce("is_new_location", F.lit(0)))


def device_users(df: DataFrame, tx: DataFrame, limits: Limits = DEFAULT,
                 scope: str = "customer_id", counted: Census | None = None) -> DataFrame:
    """Distinct customers on the device in the prior 24 h (at least 1).

    A customer covers the 24 h after each use; overlapping covers are merged through the
    previous use, so the number of customers is a running total and no set is collected.
    ``df`` is the result of :func:`history_windows` over ``tx``.
    """
    t, prev = F.col("us"), F.col("_last_dev.us")
    begin = F.when(prev.isNull() | (prev < t - F.lit(DAY)), t).otherwise(prev + F.lit(DAY))
    step = lambda at, delta: F.struct(at.alias("at"), F.lit(delta).alias("d"))
    cover = F.array(step(t, 0), step(begin, 1), step(t + F.lit(DAY), -1))
    steps = F.when(S.known_device(F.col("_dev")) & F.col("_first"), cover).otherwise(F.array(step(t, 0)))
    # rows without a device share no key: they are spread over their own ids
    lane = F.coalesce(_lane(F.col("_dev"), scope), F.concat(F.lit("\u0000"), "transaction_id"))
    points = df.withColumn("_lane", lane).withColumn("_step", F.explode(steps))
    own = F.col("_step.d") == 0
    points = points.select(
        *[F.when(own, F.col(c)).alias(c) for c in df.columns], "_lane",
        F.col("_step.at").alias("at"), F.col("_step.d").alias("d"))
    uses = tx.withColumn("_lane", _lane(F.trim(F.coalesce("device_id", F.lit(""))), scope))
    # every use opens and may close a cover: both ends shape the cuts of a hot device
    ends = uses.select("_lane", F.explode(F.array("us", F.col("us") + F.lit(DAY))).alias("at"))
    hot = find_hot(uses, "_lane", ends, limits=limits, counted=counted)
    out = before(hot.segmented(points, "at"), ["_lane"], {"_users": F.col("d")}, {}, hot, us="at")
    return (
        out.where("d = 0").drop("d", "at", "_seg", "_lane")
        .withColumn("device_user_count_24h", F.greatest(F.lit(1), F.col("_users")).cast("int"))
        .drop("_users")
    )
