"""As-of state and interval joins that never pair a whole group with itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskspark.constants import DAY, SECOND
from riskspark.functions import scalar as S
from riskspark.operators.hotkeys import DEFAULT, Limits, before, census, find_hot

MONTH = 30 * DAY


def probe_totals(points: DataFrame, probes: DataFrame, key: str, totals: list[str],
                 latest: list[str] | None = None, at: str = "us", inclusive: bool = False,
                 limits: Limits = DEFAULT) -> DataFrame:
    """Running sums (and maxima) of ``points`` as seen by every probe at its time ``at``.

    ``points`` has the key, ``at`` and delta columns: a window is an entry of +x and a later
    exit of -x. One exchange on the key (and its time segment when hot); linear.
    """
    latest = latest or []
    payload = [c for c in probes.columns if c not in (key, at)]
    left = points.select(key, F.col(at).alias("_at"), *totals, *latest, F.lit(False).alias("_probe"))
    right = probes.select(key, F.col(at).alias("_at"), *payload, F.lit(True).alias("_probe"))
    both = left.unionByName(right, allowMissingColumns=True)
    counted = census(both, {key: F.col(key)}, limits=limits)
    hot = find_hot(both, key, both, at="_at", limits=limits, counted=counted)
    out = before(hot.segmented(both, "_at"), [key], {f"_s_{t}": F.col(t) for t in totals},
                 {f"_s_{t}": F.col(t) for t in latest}, hot, us="_at", inclusive=inclusive)
    return out.where("_probe").select(
        key, F.col("_at").alias(at), *payload, *[F.col(f"_s_{t}").alias(t) for t in (*totals, *latest)])


def entries_exits(df: DataFrame, key: str, values: dict[str, tuple[Column, int]],
                  inclusive: bool = False) -> DataFrame:
    """Delta points of several windows: each value enters at ``us`` and leaves ``n`` later."""
    late = 1 if inclusive else 0
    horizons = sorted({n for _, n in values.values()})
    ends = F.array(F.struct(F.col("us").alias("at"), F.lit(0).cast("bigint").alias("n")),
                   *[F.struct((F.col("us") + F.lit(n + late)).alias("at"), F.lit(n).cast("bigint").alias("n"))
                     for n in horizons])
    out = df.withColumn("_e", F.explode(ends))
    deltas = [F.when(F.col("_e.n") == 0, c).when(F.col("_e.n") == n, -c).otherwise(c * 0).alias(name)
              for name, (c, n) in values.items()]
    return out.select(key, F.col("_e.at").alias("us"), *deltas)


def velocity_at(history: DataFrame, probes: DataFrame, key: str = "customer_id",
                limits: Limits = DEFAULT) -> DataFrame:
    """Velocity snapshot for arbitrary (key, time) probes, strictly before the probe."""
    cents = (F.col("amount") * 100).cast("bigint")
    values = {f"tx_count_{h}": (F.lit(1), n * SECOND) for h, n in
              {"1m": 60, "5m": 300, "15m": 900, "1h": 3600}.items()}
    values |= {f"_c_{h}": (cents, n * SECOND) for h, n in {"5m": 300, "15m": 900, "1h": 3600}.items()}
    out = probe_totals(entries_exits(history, key, values), probes, key, list(values), limits=limits)
    for h in ("5m", "15m", "1h"):
        out = out.withColumn(f"amount_sum_{h}", F.col(f"_c_{h}") / F.lit(100.0)).drop(f"_c_{h}")
    return out


def behavior_at(history: DataFrame, probes: DataFrame, key: str = "customer_id",
                limits: Limits = DEFAULT) -> DataFrame:
    """Count, sum, mean, spread and last time of the 30 days before the probe."""
    cents = (F.col("amount") * 100).cast("bigint")
    sq = cents.cast("decimal(12,0)") * cents.cast("decimal(12,0)")
    values = {"n": (F.lit(1), MONTH), "_sum": (cents, MONTH), "_sq": (sq, MONTH)}
    points = entries_exits(history, key, values).withColumn("last_us", F.lit(None).cast("bigint"))
    seen = history.select(key, "us", F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("_sum"),
                          F.lit(0).cast("decimal(24,0)").alias("_sq"), F.col("us").alias("last_us"))
    out = probe_totals(points.unionByName(seen), probes, key, list(values), ["last_us"], limits=limits)
    n = F.col("n")
    return out.withColumns({
        "total": F.col("_sum") / F.lit(100.0),
        "mean": F.when(n > 0, F.floor((F.col("_sum") * 2 + n) / (n * 2)) / F.lit(100.0)).otherwise(0.0),
        "std": S.rnd(S.sample_std(n, F.col("_sum"), F.col("_sq")) / F.lit(100.0), 2),
        "last_us": F.when(F.col("last_us") >= F.col("us") - F.lit(MONTH), F.col("last_us")),
    }).drop("_sum", "_sq")


def last_location(tx: DataFrame, key: str = "customer_id") -> DataFrame:
    """Latest known place per key; ties go to the larger transaction id."""
    placed = tx.where(S.has_place(F.col("latitude"), F.col("longitude")))
    best = F.max_by(F.struct("latitude", "longitude", "us"), F.struct("us", "transaction_id"))
    return placed.groupBy(key).agg(best.alias("p")).select(key, "p.latitude", "p.longitude", "p.us")


def device_edges(tx: DataFrame) -> DataFrame:
    """The customer-device graph as edges, both adjacency sets in one table."""
    return (
        tx.where(S.known_device(F.col("device_id")))
        .groupBy("customer_id", F.trim("device_id").alias("device_id"))
        .agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count(F.lit(1)).alias("uses"))
    )


def interval_join(probes: DataFrame, history: DataFrame, key: str, width: int,
                  inclusive: bool = False) -> DataFrame:
    """History rows within ``width`` before each probe (``probe_us``), by key and time bucket.

    For few probes per key; totals over many probes belong to :func:`probe_totals`.
    """
    bucket = F.explode(F.sequence(F.expr(f"(probe_us - {width}) div {width}"), F.expr(f"probe_us div {width}")))
    left = probes.withColumn("_bucket", bucket)
    right = history.withColumn("_bucket", F.expr(f"us div {width}"))
    upper = F.col("us") <= F.col("probe_us") if inclusive else F.col("us") < F.col("probe_us")
    return left.join(right, [key, "_bucket"]).where(
        upper & (F.col("us") >= F.col("probe_us") - F.lit(width))).drop("_bucket")


def shadow_compare(production: DataFrame, challenger: DataFrame) -> DataFrame:
    """Production and challenger decision per transaction; scores on 0-100."""
    band = lambda s: F.when(s >= 70, "BLOCK").when(s >= 30, "REVIEW").otherwise("APPROVE")
    a = production.select("transaction_id", F.col("score").alias("production_score"),
                          F.col("decision").alias("production_decision"))
    b = challenger.select("transaction_id", F.col("score").alias("challenger_score"))
    out = a.join(b, "transaction_id").withColumn("challenger_decision", band(F.col("challenger_score")))
    delta = F.col("challenger_score") - F.col("production_score")
    return out.withColumns({
        "divergent": F.col("production_decision") != F.col("challenger_decision"),
        "score_delta": F.when(delta < 0, -S.rnd(-delta, 2)).otherwise(S.rnd(delta, 2))})


def shadow_divergence(compared: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    hundredths = F.sum(F.round(F.abs("score_delta") * 100).cast("bigint"))
    return compared.agg(
        n.alias("total_evaluated"), F.sum(F.col("divergent").cast("int")).alias("divergent_decisions"),
        S.rnd(F.sum(F.col("divergent").cast("int")) / n, 4).alias("divergence_rate"),
        S.rnd(hundredths / n / F.lit(100.0), 2).alias("mean_absolute_score_delta"))


def attach_labels(decisions: DataFrame, labels: DataFrame, tx: DataFrame) -> DataFrame:
    """Labels onto decisions; a label without a decision makes a placeholder decision."""
    seen = F.col("d.transaction_id").isNotNull()
    marked = F.col("l.transaction_id").isNotNull()
    joined = decisions.alias("d").join(labels.alias("l"), F.expr("d.transaction_id = l.transaction_id"), "full")
    out = joined.select(
        F.coalesce("d.transaction_id", "l.transaction_id").alias("transaction_id"),
        F.col("d.customer_id").alias("customer_id"), seen.alias("_seen"), marked.alias("_marked"),
        *[F.col(f"d.{c}").alias(c) for c in ("decision", "risk_score", "risk_level", "workflow_status", "created_us")],
        F.col("l.fraud_label").alias("fraud_label"), F.col("l.reported_us").alias("label_us"))
    who = tx.select("transaction_id", F.col("customer_id").alias("_customer"), F.col("us").alias("_us"))
    out = out.join(who, "transaction_id", "left")
    fill = lambda c, v: F.when(F.col("_seen"), F.col(c)).otherwise(v)
    # The placeholder decision.
    return out.select(
        "transaction_id", fill("customer_id", F.coalesce("_customer", F.lit("unknown"))).alias("customer_id"),
        fill("decision", F.lit("APPROVE")).alias("decision"), fill("risk_score", F.lit(15.0)).alias("risk_score"),
        fill("risk_level", F.lit("LOW")).alias("risk_level"),
        fill("workflow_status", F.lit("CONFIRMED_FRAUD")).alias("workflow_status"),
        fill("created_us", F.coalesce("_us", "label_us")).alias("created_us"), "fraud_label", "label_us")


def ledger_view(tx: DataFrame, decisions: DataFrame) -> DataFrame:
    side = decisions.select("transaction_id", F.col("decision").alias("_d"), F.col("risk_score").alias("_s"))
    return tx.join(side, "transaction_id", "left").withColumns({
        "decision": F.coalesce("_d", F.lit("APPROVE")), "risk_score": F.coalesce("_s", F.lit(0.0))}).drop("_d", "_s")


def replays(log: DataFrame, key: str) -> DataFrame:
    """Copies per id and the row that came first; counts combine before the shuffle."""
    return log.groupBy(key).agg(
        F.count(F.lit(1)).alias("copies"), F.min_by("status", F.struct("us", "copy")).alias("first_status")
    ).withColumn("duplicates", F.col("copies") - 1)


def newest(df: DataFrame, order: str, n: int, tie: str) -> DataFrame:
    """Top-n without a full sort."""
    return df.orderBy(F.col(order).desc(), F.col(tie)).limit(n)
