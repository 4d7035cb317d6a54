"""Signals, weighted fusion, escalation, decisions and the decision event."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskspark.constants import (
    BLOCK_SCORE, BOOST_PER_TRIGGER, DEFAULT_REASON, HARD_BLOCK_SCORE, MIN_TRIGGERS, ML_BLOCK,
    ML_REVIEW, REASON_TEXT, REVIEW_SCORE, TRIGGERS, WEIGHTS,
)
from riskspark.functions.scalar import rnd
from riskspark.operators import rules as R

SIGNALS = {"ml": "calibrated_probability", "velocity": "velocity_signal",
           "behavioral": "behavioral_signal", "rules": "rules_signal", "anomaly": "anomaly_signal"}
NAMESPACE_OID = "6ba7b8129dad11d180b400c04fd430c8"


def unit(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def finite(x: Column, fallback: float = 0.0) -> Column:
    x = x.cast("double")
    ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(ok, x).otherwise(F.lit(fallback))


def velocity_signal(n_5m: Column, n_1h: Column) -> Column:
    a, b = (F.greatest(finite(n), F.lit(0.0)) for n in (n_5m, n_1h))
    return unit(a / F.lit(5.0) * F.lit(0.6) + b / F.lit(15.0) * F.lit(0.4))


def behavioral_signal(z: Column, new_device: Column, new_location: Column) -> Column:
    return unit(F.abs(finite(z)) / F.lit(4.0) * F.lit(0.5) + unit(finite(new_device)) * F.lit(0.3)
                + unit(finite(new_location)) * F.lit(0.2))


def bounded_signal(x: Column, fallback: float = 0.0) -> Column:
    return unit(finite(x, fallback))


def signals(df: DataFrame, probability: Column, anomaly: Column) -> DataFrame:
    """The five signals; ``df`` went through rule evaluation."""
    return df.withColumns({
        "calibrated_probability": probability.cast("double"),
        "velocity_signal": velocity_signal(F.col("tx_count_5m"), F.col("tx_count_1h")),
        "behavioral_signal": behavioral_signal(
            F.col("amount_zscore"), F.col("is_new_device"), F.col("is_new_location")),
        "rules_signal": bounded_signal(F.col("rules_signal")),
        "anomaly_signal": bounded_signal(anomaly),
    })


def contract_faults(df: DataFrame) -> DataFrame:
    """Names of signals that are not finite numbers in [0, 1]."""
    def bad(name: str) -> Column:
        x = F.col(name).cast("double")
        return F.when(x.isNull() | F.isnan(x) | (x < 0) | (x > 1), F.lit(name))
    return df.withColumn("violations", F.array_compact(F.array(*[bad(s) for s in SIGNALS.values()])))


def strict_contract(df: DataFrame, raw: str = "signals") -> DataFrame:
    """Signals as they arrive, a map of texts: adds ``faults`` (signal and reason, in signal order) and
    ``accepted``. A signal that is missing, a boolean, no number, not finite or out of range is refused."""
    def fault(name: str) -> Column:
        text = F.trim(F.col(raw)[name])
        x = text.try_cast("double")
        why = (F.when(text.isNull(), "missing").when(F.lower(text).isin("true", "false"), "boolean").when(x.isNull(), "not numeric")
               .when(F.isnan(x) | (F.abs(x) == float("inf")), "not finite").when((x < 0) | (x > 1), "out of range"))
        return F.when(why.isNotNull(), F.concat(F.lit(f"{name}: "), why))
    out = df.withColumn("faults", F.array_compact(F.array(*[fault(s) for s in SIGNALS.values()])))
    return out.withColumn("accepted", F.size("faults") == 0)


def split_contract(df: DataFrame, raw: str = "signals") -> tuple[DataFrame, DataFrame]:
    """(rows whose five signals hold the strict contract, as numbers; rejected rows with their faults)."""
    checked = strict_contract(df, raw)
    numbers = {s: F.col(raw)[s].try_cast("double") for s in SIGNALS.values()}
    return checked.where("accepted").withColumns(numbers).drop("faults", "accepted"), checked.where(~F.col("accepted")).drop("accepted")


def check_weights(weights: dict[str, float]) -> None:
    if abs(sum(weights.values()) - 1.0) > 1e-5 or not all(0 <= w <= 1 for w in weights.values()):
        raise ValueError(f"weights must be within [0, 1] and sum to 1: {weights}")


def weighted(weights: dict[str, float] = WEIGHTS) -> Column:
    check_weights(weights)
    return reduce(lambda a, b: a + b, [F.lit(float(w)) * F.col(SIGNALS[s]) for s, w in weights.items()])


def contributions(df: DataFrame, weights: dict[str, float] = WEIGHTS, digits: int = 2) -> DataFrame:
    """Weighted score and each signal's part of it, on 0-100 and in percent."""
    out = df.withColumn("weighted_score", rnd(weighted(weights) * F.lit(100.0), digits))
    parts = {f"part_{s}": rnd(F.col(SIGNALS[s]) * F.lit(float(w)) * F.lit(100.0), digits)
             for s, w in weights.items()}
    out = out.withColumns(parts)
    share = {f"share_{s}": F.when(F.col("weighted_score") > 0, rnd(
        F.col(f"part_{s}") / F.col("weighted_score") * F.lit(100.0), digits)).otherwise(0.0)
        for s in weights}
    return out.withColumns(share)


def escalation(df: DataFrame) -> DataFrame:
    """Signals above their trigger; two or more add points."""
    fired = F.array_compact(F.array(*[
        F.when(F.col(SIGNALS[s]) > F.lit(limit), F.lit(s)) for s, limit in TRIGGERS.items()]))
    out = df.withColumn("active_triggers", fired).withColumn("trigger_count", F.size("active_triggers"))
    boost = F.col("trigger_count") * F.lit(int(BOOST_PER_TRIGGER * 100)) / F.lit(100.0)
    return out.withColumn("escalation_boost", F.when(
        F.col("trigger_count") >= MIN_TRIGGERS, boost).otherwise(0.0))


def decide(score: Column, hard: Column) -> tuple[Column, Column, Column]:
    """Decision, level and effective score."""
    decision = (F.when(hard | (score >= BLOCK_SCORE), "BLOCK")
                .when(score >= REVIEW_SCORE, "REVIEW").otherwise("APPROVE"))
    level = F.when(hard | (score >= BLOCK_SCORE), "HIGH").when(score >= REVIEW_SCORE, "MEDIUM").otherwise("LOW")
    return decision, level, F.when(hard, F.greatest(score, F.lit(HARD_BLOCK_SCORE))).otherwise(score)


def ml_decision(p: Column) -> Column:
    """Bands of the calibrated probability; an invalid one has no decision."""
    valid = p.isNotNull() & ~F.isnan(p) & (p >= 0) & (p <= 1)
    return F.when(valid, F.when(p < ML_REVIEW, "APPROVE").when(p < ML_BLOCK, "REVIEW").otherwise("BLOCK"))


def fuse(df: DataFrame, weights: dict[str, float] = WEIGHTS, compound: bool = True,
         digits: int = 1) -> DataFrame:
    """Fusion, escalation and decision over a frame that carries the five signals."""
    out = escalation(contributions(df, weights))
    boost = F.col("escalation_boost") if compound else F.lit(0.0)
    score = rnd(F.least(F.lit(1.0), weighted(weights) + boost) * F.lit(100.0), digits)
    decision, level, effective = decide(F.col("_score"), F.col("hard_block"))
    return (
        out.withColumn("_score", score)
        .withColumns({"risk_score": effective, "decision": decision, "risk_level": level,
                      "ml_decision": ml_decision(F.col("calibrated_probability"))})
        .drop("_score")
    )


ATTRIBUTED = ["tx_count_5m", "amount_zscore", "speed_kmh_from_prev_tx", "is_new_device",
              "is_new_location", "auth_factor_verified", "isolation_forest_score"]


def attributions(df: DataFrame, k: int = 3) -> DataFrame:
    """Bounded sensitivity per feature, largest first, ties in feature order."""
    def weight(f: str) -> Column:
        x = F.col(f)
        if f.startswith("is_new"):
            return F.when(x == 1, 0.25).otherwise(0.0)
        if f == "auth_factor_verified":
            return F.when(x == 0, 0.35).otherwise(0.0)
        return F.greatest(F.lit(0.0), x.cast("double") * F.lit(0.1))
    items = F.array(*[F.struct((-weight(f)).alias("neg"), F.lit(i).alias("i"), F.lit(f).alias("feature"))
                      for i, f in enumerate(ATTRIBUTED)])
    return df.withColumn("attributions", F.slice(F.array_sort(items), 1, k))


def reasons(df: DataFrame) -> DataFrame:
    """Sentences of the attributions above 0.01, at most three."""
    text = F.create_map(*[F.lit(x) for kv in REASON_TEXT.items() for x in kv])
    said = F.transform(
        F.filter("attributions", lambda a: (-a["neg"] > 0.01)), lambda a: F.try_element_at(text, a["feature"]))
    said = F.slice(F.array_compact(said), 1, 3)
    return df.withColumn("reasons", F.when(F.size(said) == 0, F.array(F.lit(DEFAULT_REASON))).otherwise(said))


def score_transactions(features: DataFrame, probability: Column, anomaly: Column,
                       rules: list[R.Rule] = R.DEFAULT_RULES,
                       weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Rules, signals, fusion, decision and the three leading reasons (rules first)."""
    out = reasons(attributions(R.evaluate(features, rules)))
    out = fuse(signals(out, probability, anomaly), weights)
    merged = F.slice(F.array_distinct(F.concat("rule_reasons", "reasons")), 1, 3)
    return out.withColumn("reasons", merged)


def uuid5(name: Column, namespace_hex: str = NAMESPACE_OID) -> Column:
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int")
    variant = F.lower(F.hex((nibble.bitwiseAND(3)).bitwiseOR(8)))
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3),
        F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def seconds_text(us: Column) -> Column:
    """Epoch seconds with four decimals, from whole microseconds."""
    t = F.floor((us + F.lit(50)) / F.lit(100)).cast("bigint")
    whole = F.floor(t / F.lit(10_000)).cast("bigint")
    return F.concat(whole.cast("string"), F.lit("."), F.lpad((t % 10_000).cast("string"), 4, "0"))


def decision_events(scored: DataFrame, model_version: str = "model-v1",
                    schema_version: str = "1.0", feature_schema: str = "2.0") -> DataFrame:
    """The versioned event with a deterministic id, its faults and its sorted-key JSON."""
    sec = seconds_text(F.col("us"))
    out = scored.withColumns({
        "event_id": uuid5(F.concat_ws(":", "transaction_id", F.lit(model_version), sec)),
        "timestamp": sec.cast("double"),
        "model_version": F.lit(model_version), "schema_version": F.lit(schema_version),
        "event_type": F.lit("fraud_decision"), "feature_schema_version": F.lit(feature_schema),
    })
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    p, s = F.col("calibrated_probability"), F.col("risk_score")
    faults = F.array_compact(F.array(
        F.when(blank("transaction_id"), "transaction_id"), F.when(blank("customer_id"), "customer_id"),
        F.when(p.isNull() | F.isnan(p) | (p < 0) | (p > 1), "calibrated_probability"),
        F.when(s.isNull() | F.isnan(s) | (s < 0) | (s > 100), "risk_score")))
    signal_struct = F.struct(*[rnd(F.col(c), 4).alias(c) for c in sorted(SIGNALS.values())])
    diagnostics = F.struct("active_triggers", "escalation_boost", "trigger_count", "weighted_score")
    body = F.struct(
        rnd(p, 6).alias("calibrated_probability"), "customer_id", "decision",
        diagnostics.alias("diagnostics"), "event_id", "event_type", "feature_schema_version",
        "hard_block", "hard_block_rules", "matched_rules", "ml_decision", "model_version", "reasons",
        "risk_level", rnd(s, 4).alias("risk_score"), "schema_version",
        signal_struct.alias("signals"), "timestamp", "transaction_id")
    return out.withColumn("event_faults", faults).withColumn("event_json", F.to_json(body))


def decision_mix(df: DataFrame) -> DataFrame:
    """Counts and shares by decision, level, hard block and trigger, in one pass."""
    tags = F.concat(
        F.array(F.struct(F.lit("decision").alias("kind"), F.upper("decision").alias("label")),
                F.struct(F.lit("risk_level").alias("kind"), F.upper("risk_level").alias("label")),
                F.struct(F.lit("hard_block").alias("kind"), F.col("hard_block").cast("string").alias("label"))),
        F.transform("active_triggers", lambda t: F.struct(F.lit("trigger").alias("kind"), t.alias("label"))),
        F.array(F.struct(F.lit("all").alias("kind"), F.lit("all").alias("label"))))
    counts = df.select(F.explode(tags).alias("t")).groupBy("t.kind", "t.label").agg(F.count(F.lit(1)).alias("n"))
    # about fifteen labels: the total travels in the grouped rows, not in a join
    every = F.max(F.when(F.col("kind") == "all", F.col("n"))).over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("percent", rnd(F.col("n") * F.lit(100.0) / every, 2)).where("kind <> 'all'")


def heuristic_score(df: DataFrame) -> DataFrame:
    """The early additive score, capped at 1, with its explanations."""
    amount, balance = F.col("amount").cast("double"), F.col("oldbalanceOrg")
    ratio = amount / (balance + F.lit(1e-5))
    on = lambda c, w: F.when(c, F.lit(w)).otherwise(F.lit(0.0))
    score = (
        F.when(balance > 0, F.when(ratio > 1.0, F.least(F.lit(0.4), ratio * F.lit(0.1))).otherwise(0.0))
        .otherwise(on(amount > 0, 0.3))
        + on(F.col("type").isin("CASH_OUT", "TRANSFER"), 0.2) + on(F.col("auth_verified") == 0, 0.2)
        + on(F.col("device_known") == 0, 0.1) + on(F.col("geo_known") == 0, 0.1)
        + on(F.col("sender_hourly_tx_count") > 5, 0.1) + on(F.col("sender_daily_tx_count") > 20, 0.1)
        + on(F.col("receiver_risk_score") > 0.7, 0.1))
    # The sentences, in this order.
    said = F.array_compact(F.array(
        F.when(F.col("auth_verified") == 0, "Auth not verified (OTP/biometric missing)"),
        F.when(F.col("device_known") == 0, "Unknown device for sender"),
        F.when(F.col("geo_known") == 0, "Unknown geo location for sender"),
        F.when(F.col("receiver_risk_score") > 0.7, "Receiver has high risk score"),
        F.when(F.col("sender_hourly_tx_count") > 5, "Sender exceeded hourly transaction count"),
        F.when(F.col("sender_daily_tx_count") > 20, "Sender exceeded daily transaction count"),
        F.when((balance == 0) & (amount > 0), "Large amount sent from zero balance account")))
    none = F.array(F.lit("No suspicious behavior detected"))
    return df.withColumns({
        "heuristic_score": F.least(score, F.lit(1.0)),
        "explanations": F.when(F.size(said) == 0, none).otherwise(said)})


# Column order of the early model input.
LEGACY_COLUMNS = [
    "step", "type", "amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest",
    "amount_balance_ratio", "unusual_device", "unusual_location", "sender_hourly_tx_count",
    "sender_daily_tx_count", "receiver_risk_score", "initiated_by_third", "auth_verified",
]


def legacy_features(df: DataFrame) -> DataFrame:
    out = df.withColumns({
        "amount_balance_ratio": F.col("amount").cast("double") / (F.col("oldbalanceOrg") + F.lit(1e-6)),
        "unusual_device": F.coalesce(F.col("device_known") == 0, F.lit(False)).cast("int"),
        "unusual_location": F.coalesce(F.col("geo_known") == 0, F.lit(False)).cast("int"),
        "initiated_by_third": F.coalesce(F.col("initiated_by") == "third_party", F.lit(False)).cast("int"),
    })
    for c in LEGACY_COLUMNS:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(0))
    return out.fillna(0)
