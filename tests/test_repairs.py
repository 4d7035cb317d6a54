"""Late device uses, null groups, repeated indicators, long secrets, row-given time parts."""

import hashlib
import hmac

from pyspark.sql import functions as F

from riskspark.operators import evaluate as E
from riskspark.operators import fusion as U
from riskspark.operators import ml as M
from riskspark.operators import ops as O
from riskspark.operators import workflow as K
from riskspark.plans import features as P
from tests.helpers import by_id, tx

def test_null_stage_keeps_its_summary(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 2.0), (None, 4.0)], "stage string, latency double")
    got = {r.stage: (r["count"], r.p50) for r in O.latency_summary(df).collect()}
    assert got == {"a": (2, 2.0), None: (2, 3.0)}


def test_long_secret(spark):
    secret = "s" * 100
    got = spark.createDataFrame([("m",)], "m string").select(K.hmac_sha256(secret, F.col("m"))).first()[0]
    assert got == hmac.new(secret.encode(), b"m", hashlib.sha256).hexdigest()


def test_synthetic_pairs_come_with_the_originals(spark):
    df = spark.createDataFrame([(f"t{i}", float(i), int(i < 6)) for i in range(20)], "transaction_id string, x double, label int")
    got = M.oversample_pairs(df, ["x"]).collect()
    assert len(got) == 20 + 12 and sum(r.label for r in got) == 18 and max(r.x for r in got if r.label) <= 5
    assert M.oversample_pairs(df, ["x"], limit=3).count() == 23


def test_row_given_hour_and_weekday(spark):
    df = tx(spark, [dict(t=0, amount=5), dict(t=60, amount=5)])
    given = df.withColumns({"hour_of_day": F.when(F.col("transaction_id") == "t1", 23), "day_of_week": F.lit(6)})
    got = by_id(P.features_32(given))
    assert (got["t0"].hour_of_day, got["t1"].hour_of_day, got["t1"].is_night, got["t1"].is_weekend) == (0, 23, 1, 1)
    assert got["t1"].user_hourly_tx_deviation == 1.0


def test_null_labels_are_a_stratum_of_their_own(spark):
    df = spark.createDataFrame([(f"t{i}", None if i % 3 == 0 else i % 2) for i in range(90)], "transaction_id string, is_fraud int")
    got = E.split_stratified(df).groupBy("is_fraud", "split").count().collect()
    assert {(r.is_fraud, r.split): r["count"] for r in got} == {
        (None, "test"): 6, (None, "train"): 24, (0, "test"): 6, (0, "train"): 24, (1, "test"): 6, (1, "train"): 24}


def test_strict_contract_refuses_each_fault(spark):
    good = dict(calibrated_probability="0.5", velocity_signal="0", behavioral_signal="1", rules_signal=" 0.2 ", anomaly_signal="1e-3")
    cases = {"ok": good, "bool": good | {"rules_signal": "True"}, "word": good | {"rules_signal": "x"}, "nan": good | {"rules_signal": "NaN"},
             "inf": good | {"rules_signal": "-Infinity"}, "high": good | {"rules_signal": "1.01"}, "none": {k: v for k, v in good.items() if k != "rules_signal"}}
    df = spark.createDataFrame(list(cases.items()), "name string, signals map<string,string>")
    passed, rejected = U.split_contract(df)
    assert [(r.name, r.rules_signal) for r in passed.collect()] == [("ok", 0.2)]
    assert {r.name: r.faults for r in rejected.collect()} == {n: [f"rules_signal: {w}"] for n, w in dict(
        bool="boolean", word="not numeric", nan="not finite", inf="not finite", high="out of range", none="missing").items()}
