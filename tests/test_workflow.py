"""Security state, mandates, holds; hot keys against the plain path."""

import random

from pyspark.sql import functions as F

from riskspark.operators import workflow as K
from riskspark.operators.hotkeys import Limits

S = 1_000_000
T0 = 1_000_000 * S


def test_takeover_golden(spark):
    events = spark.createDataFrame([("c1", T0 - 600 * S, "password_change"), ("c1", T0 - 580 * S, "new_device_registration")],
                                   "customer_id string, us bigint, event_type string")
    probe = spark.createDataFrame([("c1", T0, "t1", 1000.0), ("c1", T0 - 590 * S, "t2", 1000.0), ("c2", T0, "t3", 1.0)],
                                  "customer_id string, us bigint, transaction_id string, amount double")
    got = {r.transaction_id: r for r in K.guardrail(K.ato_score(K.security_state(probe, events))).collect()}
    assert (got["t1"].ato_score, got["t1"].ato_action, got["t1"].allowed) == (0.75, "TRIGGER_HOLD", False)
    assert (got["t2"].ato_score, got["t3"].ato_score) == (0.40, 0.0)


def test_security_state_hot_customer(spark):
    rnd = random.Random(1)
    kinds = ["password_change", "device_change", "mfa_reset", "odd", "profile_update"]
    ev = [(rnd.choice(["a", "a", "b"]), T0 + rnd.randint(0, 3 * 86400) * S, rnd.choice(kinds)) for _ in range(200)]
    pr = [(rnd.choice(["a", "a", "b"]), T0 + rnd.randint(0, 4 * 86400) * S, f"t{i}") for i in range(150)]
    events = spark.createDataFrame(ev, "customer_id string, us bigint, event_type string")
    probes = spark.createDataFrame(pr, "customer_id string, us bigint, transaction_id string")
    for limits in (Limits(), Limits(light=2, hot=10)):
        got = {r.transaction_id: r for r in K.security_state(probes, events, limits).collect()}
        for c, t, i in pr:
            seen = [e for e in ev if e[0] == c and t - 86400 * S <= e[1] <= t]
            dev = [e[1] for e in seen if e[2] == "device_change"]
            pairs = sum(any(0 <= d - e[1] <= 3600 * S for d in dev) for e in seen if e[2] == "password_change")
            assert got[i].n_followed == pairs
            assert got[i].n_mfa_reset == sum(e[2] == "mfa_reset" for e in seen) and got[i].n_other == sum(e[2] == "odd" for e in seen)


def mandate(spark, frequency="MONTHLY", status="ACTIVE"):
    return spark.createDataFrame([("m1", "c1", "b1", 500.0, frequency, status, 0, 10**17)],
                                 "mandate_id string, customer_id string, beneficiary_id string, max_amount double, frequency string,"
                                 "status string, created_us bigint, expires_us bigint")


def attempts(spark, rows):
    return spark.createDataFrame([("m1", i, T0 + int(t * S), a) for i, (t, a) in enumerate(rows)],
                                 "mandate_id string, attempt_id bigint, us bigint, amount double")


def test_mandate_golden(spark):
    out = K.execute_mandates(attempts(spark, [(0, 150.0), (10, 600.0), (20, 150.0), (29 * 86400, 150.0)]), mandate(spark))
    assert [r.reject_reason for r in out.orderBy("attempt_id").collect()] == [None, "OVER_CEILING", "TOO_EARLY", None]
    once = K.execute_mandates(attempts(spark, [(0, 1.0), (5, 1.0)]), mandate(spark, "ONCE"))
    assert [r.reject_reason for r in once.orderBy("attempt_id").collect()] == [None, "NOT_ACTIVE"]


def test_hot_mandate_equals_fold(spark):
    rnd = random.Random(5)
    rows = [(rnd.randint(0, 60 * 86400), 1.0) for _ in range(600)]
    pick = lambda limits: sorted((r.attempt_id, r.accepted) for r in K.execute_mandates(
        attempts(spark, rows), mandate(spark, "DAILY"), limits).collect())
    plain = pick(Limits())
    assert plain == pick(Limits(light=1, hot=50)) and 50 < sum(a for _, a in plain) < 64


def test_lifecycle(spark):
    commands = ["pause", "activate", "activate", "pause", "limit", "activate", "limit", "cancel", "activate", "cancel"]
    df = spark.createDataFrame([("m", i, c, 10.0) for i, c in enumerate(commands)], "mandate_id string, seq bigint, command string, new_limit double")
    for limits in (Limits(), Limits(light=1, hot=3)):
        got = K.mandate_lifecycle(df, limits).orderBy("seq").collect()
        assert [r.accepted for r in got] == [False, True, False, True, False, True, True, True, False, True]
        assert got[-1].status_after == "CANCELLED"


def test_holds(spark):
    holds = spark.createDataFrame([(f"h{i}", f"t{i}", T0) for i in range(5)], "hold_id string, transaction_id string, created_us bigint")
    acts = [("h0", 1, "CONFIRM", True, 10), ("h0", 2, "CONFIRM", False, 20), ("h0", 3, "DENY", True, 30),
            ("h1", 1, "CONFIRM", False, 10), ("h1", 2, "DENY", True, 20), ("h2", 1, "CONFIRM", False, 301), ("h3", 1, "CONFIRM", False, 5)]
    actions = spark.createDataFrame([(h, q, a, ok, T0 + t * S) for h, q, a, ok, t in acts],
                                    "hold_id string, seq int, action string, token_ok boolean, us bigint")
    outcome, verdicts = K.resolve_holds(holds, actions)
    assert {r.hold_id: r.status for r in outcome.collect()} == {"h0": "RELEASED", "h1": "DENIED", "h2": "EXPIRED", "h3": "HOLD", "h4": "HOLD"}
    assert [(r.hold_id, r.verdict) for r in verdicts.orderBy("hold_id", "seq").collect()] == [
        ("h0", "APPLIED"), ("h0", "IDEMPOTENT"), ("h0", "ERROR_TERMINAL"), ("h1", "INVALID_TOKEN"), ("h1", "APPLIED"),
        ("h2", "ERROR_EXPIRED"), ("h3", "INVALID_TOKEN")]
    assert {r.hold_id for r in K.expired_holds(holds, actions, T0 + 400 * S).collect()} == {"h3", "h4"}


def test_hold_id_is_one_per_transaction(spark):
    req = spark.createDataFrame([("t1", "h2", T0 + 5), ("t1", "h1", T0)], "transaction_id string, hold_id string, created_us bigint")
    got = K.create_holds(req, "s").collect()
    assert len(got) == 1 and got[0].hold_id == "h1" and len(got[0].token_hash) == 64


def test_settlement_is_balanced(spark):
    df = spark.createDataFrame([("a", "b", 5.0), ("b", "a", 2.0)], "customer_id string, merchant_id string, amount double")
    assert {r.account: r.net for r in K.settle(df).collect()} == {"a": -3.0, "b": 3.0}
    assert K.settle(df).agg(F.sum("net")).first()[0] == 0.0
