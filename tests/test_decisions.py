"""Rules, fusion and event golden cases."""

import hmac
import json
import uuid
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from riskspark.operators import fusion as U
from riskspark.operators import rules as R
from riskspark.operators import workflow as K

CALM = dict(tx_count_1m=0, tx_count_5m=0, tx_count_1h=0, origin_balance=10000.0, amount=100.0, amount_zscore=0.0,
            device_user_count_24h=1, is_new_device=0, is_new_location=0, distance_from_home_km=0.0,
            auth_factor_verified=1, is_night=0, payment_type="PAYMENT", speed_kmh_from_prev_tx=0.0)


def matched(spark, **change):
    df = spark.createDataFrame([{**CALM, **change}])
    row = R.evaluate(df).first()
    return {m.rule_id for m in row.matched_rules}, row


@pytest.mark.parametrize("rule,change", [
    ("VEL_MICRO_SPIKE", dict(tx_count_1m=4)), ("VEL_5M_BURST", dict(tx_count_5m=6)), ("VEL_1H_SURGE", dict(tx_count_1h=15)),
    ("AMT_BALANCE_DEPLETION", dict(amount=9600.0)), ("AMT_EXTREME_ZSCORE", dict(amount_zscore=4.0)),
    ("AMT_ZERO_BALANCE_HIGH_VALUE", dict(origin_balance=0.0, amount=5001.0)),
    ("DEV_SUSPICIOUS_MULTI_USER", dict(device_user_count_24h=5)),
    ("LOC_DEV_ANOMALOUS_COMBINATION", dict(is_new_device=1, is_new_location=1, distance_from_home_km=501.0)),
    ("AUTH_MISSING_STEP_UP", dict(auth_factor_verified=0)),
    ("AUTH_HIGH_VALUE_UNVERIFIED", dict(auth_factor_verified=0, amount=2501.0)),
    ("CTX_HIGH_AMOUNT_NIGHT_TRANSFER", dict(is_night=1, payment_type="transfer", amount=3001.0)),
    ("CTX_HIGH_DRAIN_UNVERIFIED", dict(auth_factor_verified=0, amount=9100.0, tx_count_1m=2)),
    ("BLOCK_IMPOSSIBLE_TRAVEL", dict(speed_kmh_from_prev_tx=801.0)),
    ("BLOCK_ZERO_BALANCE_HIGH_DRAIN_NO_AUTH", dict(origin_balance=0.0, amount=10001.0, auth_factor_verified=0)),
    ("BLOCK_UNVERIFIED_RAPID_DRAIN", dict(auth_factor_verified=0, amount=9100.0, tx_count_1m=3)),
])
def test_each_rule(spark, rule, change):
    assert rule in matched(spark, **change)[0]


def test_calm_row_and_clamp(spark):
    ids, row = matched(spark)
    assert not ids and row.rule_decision == "APPROVE" and row.rules_signal == 0.0
    _, row = matched(spark, auth_factor_verified=0, amount=9700.0)
    assert row.rules_signal == 1.0 and row.rule_decision == "BLOCK" and not row.hard_block


def test_fusion_golden(spark):
    df = spark.createDataFrame([(0.80, 0.60, 0.40, 0.20, 0.50, False)],
                               "calibrated_probability double, velocity_signal double, behavioral_signal double,"
                               "rules_signal double, anomaly_signal double, hard_block boolean")
    plain = U.fuse(df, compound=False).first()
    assert (plain.risk_score, plain.decision, plain.risk_level, plain.ml_decision) == (59.0, "REVIEW", "MEDIUM", "BLOCK")
    boosted = U.fuse(df).first()
    assert boosted.active_triggers == ["ml", "velocity", "behavioral"] and boosted.risk_score == 95.0
    hard = U.fuse(df.withColumn("hard_block", F.lit(True)), compound=False).first()
    assert (hard.decision, hard.risk_score) == ("BLOCK", 85.0)


@pytest.mark.parametrize("score,want", [(29.9, "APPROVE"), (30.0, "REVIEW"), (69.9, "REVIEW"), (70.0, "BLOCK")])
def test_bands(spark, score, want):
    d, _, _ = U.decide(F.lit(score), F.lit(False))
    assert spark.range(1).select(d).first()[0] == want


def test_weights_must_sum_to_one():
    with pytest.raises(ValueError):
        U.check_weights({"ml": 0.9, "velocity": 0.2})


def test_event_id_and_json(spark):
    df = spark.createDataFrame([("tx1", "c1", 1_700_000_000_123_450, 0.5)], "transaction_id string, customer_id string, us bigint, calibrated_probability double")
    cols = dict(velocity_signal=0.1, behavioral_signal=0.2, rules_signal=0.3, anomaly_signal=0.4, risk_score=40.0, decision="REVIEW",
                risk_level="MEDIUM", ml_decision="REVIEW", hard_block=False, trigger_count=0, escalation_boost=0.0, weighted_score=40.0)
    df = df.withColumns({k: F.lit(v) for k, v in cols.items()}).withColumns({
        "active_triggers": F.array().cast("array<string>"), "reasons": F.array(F.lit("a")), "hard_block_rules": F.array().cast("array<string>"),
        "matched_rules": F.array().cast("array<string>")})
    row = U.decision_events(df).first()
    assert row.event_id == str(uuid.uuid5(uuid.NAMESPACE_OID, "tx1:model-v1:1700000000.1235"))
    body = json.loads(row.event_json)
    assert list(body) == sorted(body) and body["signals"]["velocity_signal"] == 0.1 and row.event_faults == []
    bad = U.decision_events(df.withColumn("customer_id", F.lit(" ")).withColumn("risk_score", F.lit(101.0))).first()
    assert bad.event_faults == ["customer_id", "risk_score"]


def test_hmac(spark):
    got = spark.createDataFrame([("h:t",)], "m string").select(K.hmac_sha256("secret", F.col("m"))).first()[0]
    assert got == hmac.new(b"secret", b"h:t", sha256).hexdigest()


def test_signals_are_monotone(spark):
    df = spark.createDataFrame([(i,) for i in range(0, 40)], "n int").select(U.velocity_signal(F.col("n"), F.col("n")).alias("s"), "n")
    s = [r.s for r in df.orderBy("n").collect()]
    assert s == sorted(s) and s[-1] == 1.0
