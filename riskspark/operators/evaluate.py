"""Splits, audits, ranking curves, thresholds and model tables.

Scored frames have ``label`` (0/1) and ``p``. Results are frames, one row or one row per bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskspark.constants import WEIGHT_SETS, WEIGHTS
from riskspark.functions.scalar import rnd
from riskspark.operators.distsort import global_row_number, rank_threshold, running_totals
from riskspark.session import broadcast_if_small, cut_lineage

BIG = "decimal(38,0)"


# --- splits ----------------------------------------------------------------------------

def split_temporal(df: DataFrame, order: str = "us", tie: str = "transaction_id",
                   train: float = 0.70, val: float = 0.15) -> DataFrame:
    """First 70 %, next 15 % and last 15 % of global time order.

    Only the two cut points are searched, by counting over a narrow copy of ``order`` and ``tie``;
    the split is then a map-side filter. Rows that share the instant of a cut are ordered by ``tie``.
    """
    keys = cut_lineage(df.select(order, tie))
    n = keys.count()
    cuts = [int(n * train), int(n * (train + val) + 1e-9)]
    bounds = [_cut(keys, order, tie, c, n) for c in cuts]

    def before_cut(cut: tuple | None) -> Column:
        if cut is None:
            return F.lit(True)
        at, name = cut
        return (F.col(order) < at) | ((F.col(order) == at) & (F.col(tie) < name))
    return df.withColumn("split", F.when(before_cut(bounds[0]), "train").when(before_cut(bounds[1]), "val").otherwise("test"))


def _cut(df: DataFrame, order: str, tie: str, rank: int, n: int) -> tuple | None:
    """The (time, id) of the row at ``rank`` of ``n``; None when the rank is past the end."""
    if rank >= n:
        return None
    at, below = rank_threshold(df, order, rank)
    same = global_row_number(df.where(F.col(order) == at).select(tie), [F.col(tie)])
    name = same.where(F.col("rn") == rank - below + 1).first()[tie]
    return at, name


def split_summary(df: DataFrame, label: str = "is_fraud", numbers: list[str] | None = None) -> DataFrame:
    """Rows, fraud, time range and unusable numbers per split, with an order check."""
    bad = [F.sum((F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
                  | (F.abs(F.col(c).cast("double")) == float("inf"))).cast("int")) for c in (numbers or [])]
    order = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)
    out = df.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(label).alias("fraud"), F.min("us").alias("first_us"),
        F.max("us").alias("last_us"), sum(bad[1:], bad[0]).alias("bad_numbers") if bad else F.lit(0).alias("bad_numbers"))
    ranked = cut_lineage(out.withColumn("_o", order))  # three rows
    prior = ranked.select((F.col("_o") + 1).alias("_o"), F.col("last_us").alias("_prev"))
    return ranked.join(prior, "_o", "left").withColumn(
        "in_order", F.coalesce(F.col("first_us") >= F.col("_prev"), F.lit(True))).drop("_o", "_prev")


def hash_order(*parts: Column) -> Column:
    """A reproducible pseudo-random order, the same on every engine."""
    return F.md5(F.concat_ws(":", *parts))


def _leading(df: DataFrame, count: int, key: str, seed: int) -> Column:
    """Predicate of the first ``count`` rows in hash order.

    The cut is found by counting the leading hash bits; nothing is sorted or shuffled but the
    rows that share those bits with the cut.
    """
    h = hash_order(F.lit(str(seed)), F.col(key))
    lead = F.conv(F.substring(h, 1, 12), 16, 10).cast("bigint")
    if count <= 0:
        return F.lit(False)
    hashed = df.select(F.col(key), lead.alias("_lead"), h.alias("_h"))
    at, below = rank_threshold(hashed, "_lead", count - 1)
    ties = global_row_number(hashed.where(F.col("_lead") == at).select("_h", key), [F.col("_h"), F.col(key)])
    last = ties.where(F.col("rn") == count - below).first()
    return (lead < at) | ((lead == at) & (F.struct(h, F.col(key)) <= F.struct(F.lit(last["_h"]), F.lit(last[key]))))


def split_stratified(df: DataFrame, label: str = "is_fraud", key: str = "transaction_id",
                     test: float = 0.2, seed: int = 42) -> DataFrame:
    """80/20 split that keeps the label ratio exactly: per label (null is one), the first 20 % in hash order."""
    in_test = F.lit(False)
    for row in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect():  # one row per label
        one = F.col(label).eqNullSafe(F.lit(row[label]))
        in_test = in_test | (one & _leading(df.where(one), int(row.n * test), key, seed))
    return df.withColumn("split", F.when(in_test, "test").otherwise("train"))


def audit(df: DataFrame, label: str, types: str) -> DataFrame:
    """Rows, nulls per column, duplicates, type counts and class balance as (metric, item, value)."""
    n = F.count(F.lit(1))
    one = df.agg(n.alias("_rows"), *[F.sum(F.col(c).isNull().cast("int")).alias(f"_null_{c}") for c in df.columns])
    row = lambda m, i, v: F.struct(F.lit(m).alias("metric"), F.lit(i).alias("item"), v.cast("double").alias("value"))
    items = [row("rows", "all", F.col("_rows")), row("columns", "all", F.lit(len(df.columns)))]
    for c in df.columns:
        items += [row("nulls", c, F.col(f"_null_{c}")),
                  row("null_percent", c, rnd(F.col(f"_null_{c}") * F.lit(100.0) / F.col("_rows"), 2))]
    out = one.select(F.explode(F.array(*items)).alias("x")).select("x.*")
    # equal rows meet by their hash, so wide rows are not shuffled
    copies = df.groupBy(F.xxhash64(*df.columns).alias("a"), F.hash(*df.columns).alias("b")).agg(n.alias("c"))
    dup = copies.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).cast("double").alias("value")).select(
        F.lit("duplicate_rows").alias("metric"), F.lit("all").alias("item"), "value")
    per = lambda col, m: df.groupBy(F.col(col).cast("string").alias("item")).agg(n.cast("double").alias("value")).select(
        F.lit(m).alias("metric"), "item", "value")
    return out.unionByName(dup).unionByName(per(types, "type_count")).unionByName(per(label, "class_count"))


# --- curves ----------------------------------------------------------------------------

def score_counts(scored: DataFrame, label: str = "label", score: str = "p",
                 group: list[str] | None = None) -> DataFrame:
    """One row per distinct score with its positives and negatives."""
    return scored.groupBy(*(group or []), F.col(score).alias("p")).agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"), F.sum((1 - F.col(label)).cast("bigint")).alias("neg"))


def curve(scored: DataFrame, label: str = "label", score: str = "p",
          group: list[str] | None = None) -> DataFrame:
    """Per distinct score, descending: cumulative true and false positives and the totals.

    ``corner`` marks the points a collinearity-free ROC curve keeps: the ends, and those whose
    counts differ from the next point's.
    """
    group = group or []
    totals = {"tp": F.col("pos"), "fp": F.col("neg"), "i": F.lit(1)}
    counts = score_counts(scored, label, score, group)
    run = cut_lineage(running_totals(counts, [F.col("p").desc()], totals, group))
    whole = [F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.max("i").alias("_last")]
    if group:
        run = run.join(broadcast_if_small(run.groupBy(*group).agg(*whole)), group)
    else:
        one = run.agg(*whole).first()  # three numbers
        run = run.withColumns({c: F.lit(one[c]) for c in ("n_pos", "n_neg", "_last")})
    after = run.select(*group, (F.col("i") - 1).alias("i"), F.col("pos").alias("_np"), F.col("neg").alias("_nn"))
    out = run.join(after, [*group, "i"], "left")
    ends = (F.col("i") == 1) | (F.col("i") == F.col("_last"))
    corner = ends | (F.col("pos") != F.col("_np")) | (F.col("neg") != F.col("_nn"))
    return out.withColumn("corner", corner).drop("_np", "_nn", "_last")


def ranking_metrics(points: DataFrame, max_fpr: float = 0.01, group: list[str] | None = None) -> DataFrame:
    """ROC-AUC, PR-AUC (trapezoid), average precision (step) and recall at a false positive rate."""
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "pos", "neg"))
    P, N = F.max("n_pos"), F.max("n_neg")
    area = F.sum(neg.cast(BIG) * (tp * 2 - pos).cast("decimal(20,0)"))
    flagged_before = tp - pos + fp - neg
    prev = F.when(flagged_before > 0, (tp - pos) / flagged_before).otherwise(1.0)
    here = tp / (tp + fp)
    fpr = fp / F.greatest(F.col("n_neg"), F.lit(1))
    return points.groupBy(*(group or [])).agg(
        rnd(F.coalesce(area.cast("double") / (P.cast("double") * N.cast("double") * 2), F.lit(0.5)), 4).alias("roc_auc"),
        rnd(F.sum(pos * (prev + here) / 2.0) / P, 4).alias("pr_auc"),
        rnd(F.sum(pos * here) / P, 4).alias("avg_precision"),
        rnd(F.coalesce(F.max(F.when(F.col("corner") & (fpr <= max_fpr), tp)), F.lit(0)) / P, 4).alias("recall_at_fpr"))


def confusion(scored: DataFrame, threshold: float = 0.5, label: str = "label", score: str = "p") -> DataFrame:
    hit, real = F.col(score) >= F.lit(threshold), F.col(label) == 1
    c = lambda x: F.sum(x.cast("int"))
    out = scored.agg(c(hit & real).alias("tp"), c(hit & ~real).alias("fp"), c(~hit & ~real).alias("tn"), c(~hit & real).alias("fn"))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    ratio = lambda a, b: rnd(F.when(b > 0, a / b).otherwise(0.0), 4)
    return out.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(tp * 2, tp * 2 + fp + fn),
                            "fpr": ratio(fp, fp + tn), "fnr": ratio(fn, fn + tp)})


def brier(scored: DataFrame, label: str = "label", score: str = "p") -> DataFrame:
    return scored.agg(rnd(F.avg(F.pow(F.col(score) - F.col(label), 2)), 6).alias("brier_score"))


def calibration_bins(scored: DataFrame, bins: int = 10, label: str = "label", score: str = "p") -> DataFrame:
    """Equal-width bins, the last one closed."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return scored.groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("confidence"), F.avg(label).alias("accuracy"))


def ece(scored: DataFrame, bins: int = 10) -> DataFrame:
    gap = F.sum(F.abs(F.col("confidence") - F.col("accuracy")) * F.col("n")) / F.sum("n")
    return calibration_bins(scored, bins).agg(rnd(gap, 5).alias("ece"))


def tiers(scored: DataFrame, review: float, block: float, label: str = "label", score: str = "p") -> DataFrame:
    tier = F.when(F.col(score) < review, "approved").when(F.col(score) < block, "reviewed").otherwise("blocked")
    per = cut_lineage(scored.groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("fraud")))
    n, fraud, caught = per.agg(F.sum("n"), F.sum("fraud"), F.sum(F.when(F.col("tier") != "approved", F.col("fraud")))).first()
    rate = F.lit(caught or 0) * F.lit(100.0) / F.lit(max(fraud or 0, 1))
    return per.withColumns({"percent": rnd(F.col("n") * F.lit(100.0) / F.lit(n), 2), "detection_rate": rnd(rate, 2)})


# Fixed values: (review clip, review fallback, block floor above review, block cap, block fallback).
POLICIES = {"online": dict(clip=(0.05, 0.45), fallback=0.20, floors=(0.10,), cap=0.90, block_fallback=(0.70, 0.0)),
            "training": dict(clip=(0.01, 0.40), fallback=0.10, floors=(0.15, 0.05), cap=0.95, block_fallback=(0.60, 0.20))}


def thresholds(points: DataFrame, max_fpr: float = 0.01, min_precision: float = 0.85, policy: str = "online") -> DataFrame:
    """Review threshold from the last ROC corner within ``max_fpr``, block threshold from the
    lowest score with enough precision. The curve's own origin has no finite threshold and
    clips to the upper bound."""
    rule = POLICIES[policy]
    fpr = F.col("fp") / F.greatest(F.col("n_neg"), F.lit(1))
    ok = F.col("corner") & (fpr <= max_fpr)
    sharp = F.col("tp") >= (F.col("tp") + F.col("fp")) * F.lit(min_precision)
    out = points.agg(F.min(F.when(ok, F.col("p"))).alias("_r"), F.min(F.when(sharp, F.col("p"))).alias("_b"))
    low, high = rule["clip"]
    # the origin (nothing flagged) always satisfies the rate, so the fallback is only for no data
    review = F.least(F.greatest(F.coalesce("_r", F.lit(high)), F.lit(low)), F.lit(high))
    out = out.withColumn("tau_review", review)
    floored = F.col("_b")
    for floor in rule["floors"]:
        floored = F.greatest(floored, F.col("tau_review") + F.lit(floor))
    base, above = rule["block_fallback"]
    fallback = F.greatest(F.lit(base), F.col("tau_review") + F.lit(above)) if above else F.lit(base)
    block = F.when(F.col("_b").isNull(), fallback).otherwise(F.least(floored, F.lit(rule["cap"])))
    return out.select(rnd(F.col("tau_review"), 4).alias("tau_review"), rnd(block, 4).alias("tau_block"))


def cost_curve(scored: DataFrame, steps: list[int] = list(range(10, 95, 10)), miss: float = 2500.0,
               friction: float = 25.0, label: str = "label", score: str = "p") -> DataFrame:
    """Cost per threshold (percent) in one aggregation: a row counts for the thresholds it passes."""
    s, y = F.col(score) * 100, F.col(label)
    aggs = []
    for t in steps:
        aggs += [F.sum(((s < t) & (y == 1)).cast("int")).alias(f"fn_{t}"), F.sum(((s >= t) & (y == 0)).cast("int")).alias(f"fp_{t}")]
    one = scored.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"fn_{t}").alias("fn"), F.col(f"fp_{t}").alias("fp")) for t in steps])
    cost = F.col("fn") * F.lit(miss) + F.col("fp") * F.lit(friction)
    out = one.select(F.explode(rows).alias("r")).select("r.*").withColumn("cost", cost)
    best = one.select(F.array_min(F.transform(rows, lambda r: F.struct(
        (r["fn"] * F.lit(miss) + r["fp"] * F.lit(friction)).alias("c"), r["threshold"].alias("t"))))["t"]).first()[0]
    return out.withColumn("optimal", F.col("threshold") == F.lit(best))


# --- weight studies --------------------------------------------------------------------

def ablations(base: dict[str, float] = WEIGHTS) -> dict[str, tuple]:
    out = {}
    for gone in base:
        rest = sum(w for s, w in base.items() if s != gone)
        out[f"Ablate {gone}"] = tuple(0.0 if s == gone else w / rest for s, w in base.items())
    return out


def weight_study(df: DataFrame, sets: dict[str, tuple] | None = None, label: str = "label") -> DataFrame:
    """Decision mix and BLOCK quality per weight set, with deltas to the baseline.

    Every set is a column expression of one pass; the sets are exploded after the scan and
    combined before the shuffle.
    """
    sets = sets or {**WEIGHT_SETS, **ablations()}
    names = ("calibrated_probability", "velocity_signal", "behavioral_signal", "rules_signal", "anomaly_signal")
    def score(w):
        total = F.lit(float(w[0])) * F.col(names[0])
        for weight, s in zip(w[1:], names[1:]):
            total = total + F.lit(float(weight)) * F.col(s)
        s = rnd(total * F.lit(100.0), 2)
        return F.when(F.col("hard_block"), F.greatest(s, F.lit(85.0))).otherwise(s)
    rows = F.array(*[F.struct(F.lit(k).alias("config"), score(w).alias("score")) for k, w in sets.items()])
    x = df.select(F.col(label).alias("_y"), "hard_block", F.explode(rows).alias("c")).select("_y", "hard_block", "c.*")
    block = F.col("hard_block") | (F.col("score") >= 70)
    c = lambda cond: F.sum(cond.cast("int"))
    y = F.col("_y") == 1
    out = x.groupBy("config").agg(
        F.count(F.lit(1)).alias("n"), F.min("score").alias("min_score"), F.max("score").alias("max_score"),
        rnd(F.sum(F.round(F.col("score") * 100).cast("bigint")) / F.count(F.lit(1)) / F.lit(100.0), 3).alias("mean_score"),
        c(~block & (F.col("score") < 30)).alias("approve"), c(~block & (F.col("score") >= 30)).alias("review"),
        c(block).alias("block"), c(block & y).alias("tp"), c(block & ~y).alias("fp"), c(~block & y).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    ratio = lambda a, b: rnd(F.when(b > 0, a / b).otherwise(0.0), 4)
    out = cut_lineage(out.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)}))  # a row per set
    b = out.where("config = 'Baseline'").select("recall", "block").first()
    return out.withColumns({"block_delta": F.col("block") - F.lit(b["block"]),
                            "recall_delta": F.round((F.col("recall") - F.lit(b["recall"])) * 10000).cast("int")})


def validate_features(df: DataFrame, features: list[str]) -> DataFrame:
    """Per feature: usable and unusable values, mean, population spread, range."""
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])
    x = df.select(F.explode(rows).alias("r")).select("r.*")
    usable = F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") != float("inf"))
    v = F.when(usable, F.col("x"))
    return x.groupBy("feature").agg(
        F.count(v).alias("kept"), F.sum((~usable).cast("int")).alias("skipped"), rnd(F.avg(v), 3).alias("mean"),
        rnd(F.stddev_pop(v), 3).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))


# --- model tables ----------------------------------------------------------------------

METRIC_ORDER = ["pr_auc", "roc_auc", "recall_at_fpr", "precision", "recall", "f1", "brier_score"]


def select_candidate(metrics: DataFrame) -> DataFrame:
    """Mean metrics per model, ranked by PR-AUC, then recall; the models are few."""
    mean = cut_lineage(metrics.groupBy("model").agg(*[rnd(F.avg(c), 4).alias(c) for c in ("pr_auc", "roc_auc", "recall_at_fpr")]))
    ranked = global_row_number(mean, [F.col("pr_auc").desc(), F.col("recall_at_fpr").desc(), F.col("model")], "rank")
    return ranked.withColumn("rank", F.col("rank").cast("int"))


def pivot_metric(metrics: DataFrame, metric: str, datasets: list[str]) -> DataFrame:
    out = metrics.groupBy("model").pivot("dataset", datasets).agg(F.first(metric))
    known = sum((F.coalesce(F.col(d), F.lit(0.0)) for d in datasets[1:]), F.coalesce(F.col(datasets[0]), F.lit(0.0)))
    count = sum((F.col(d).isNotNull().cast("int") for d in datasets[1:]), F.col(datasets[0]).isNotNull().cast("int"))
    return out.withColumn("mean", rnd(known / count, 4))


def promotion_gate(metrics: DataFrame) -> DataFrame:
    """Four gates of a candidate against production; ``metrics`` has one row per role."""
    get = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c)))
    cols = ("pr_auc", "roc_auc", "brier_score", "fpr")
    one = metrics.agg(*[get(r, c).alias(f"{r}_{c}") for r in ("production", "candidate") for c in cols])
    p, c = (lambda x: F.col(f"production_{x}")), (lambda x: F.col(f"candidate_{x}"))
    # Tolerated regressions.
    out = one.withColumns({
        "pr_auc_ok": c("pr_auc") >= p("pr_auc") - 0.005, "roc_auc_ok": c("roc_auc") >= p("roc_auc") - 0.005,
        "brier_ok": c("brier_score") <= p("brier_score") + 0.010, "fpr_ok": c("fpr") <= p("fpr") * 1.15})
    passed = F.col("pr_auc_ok") & F.col("roc_auc_ok") & F.col("brier_ok") & F.col("fpr_ok")
    return out.withColumn("status", F.when(passed, "APPROVED").otherwise("REJECTED"))


def labeled_set(decisions: DataFrame, since_us: int) -> DataFrame:
    """Decisions with a label since a cutoff, newest label first when sorted by ``label_order``."""
    return decisions.where(F.col("fraud_label").isNotNull() & (F.col("created_us") >= since_us)).withColumn(
        "label_order", F.coalesce("label_us", "created_us")).orderBy(F.col("label_order").desc(), "transaction_id")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    c = lambda v: F.sum((F.col(label) == v).cast("bigint"))
    out = df.agg(c(1).alias("pos"), c(0).alias("neg"))
    n, pos, neg = F.col("pos") + F.col("neg"), F.col("pos"), F.col("neg")
    return out.withColumns({
        "scale_pos_weight": rnd(neg / F.greatest(pos, F.lit(1)), 6), "weight_pos": rnd(n / (pos * 2.0), 6),
        "weight_neg": rnd(n / (neg * 2.0), 6)})


def undersample(df: DataFrame, ratio: float = 10.0, label: str = "label", key: str = "transaction_id", seed: int = 42) -> DataFrame:
    """All positives and exactly ``ratio`` times as many negatives, in hash order."""
    pos, n = df.agg(F.sum((F.col(label) == 1).cast("bigint")), F.count(F.lit(1))).first()
    target, negative = int((pos or 0) * ratio), F.col(label) == 0
    if n - (pos or 0) <= target:
        return df
    return df.where((F.col(label) == 1) | (negative & _leading(df.where(negative), target, key, seed)))
