"""Golden windows, cold start, no look-ahead, and hot keys against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from riskspark.constants import FEATURES
from riskspark.functions import scalar as S
from riskspark.operators import asof as A
from riskspark.operators import windows as W
from riskspark.operators.hotkeys import Limits
from riskspark.plans import features as P
from tests.helpers import by_id, tx

NOW = 10_000_000
SPLIT_ALL = Limits(light=3, hot=10)


def test_velocity_golden(spark):
    rows = [dict(t=NOW - d, amount=a) for d, a in ((30, 100), (120, 200), (600, 300), (1800, 400), (7200, 500))]
    got = by_id(W.velocity(tx(spark, rows + [dict(t=NOW, amount=1)])))["t5"]
    assert [got[f"tx_count_{h}"] for h in ("1m", "5m", "15m", "1h")] == [1, 2, 3, 4]
    assert [got[f"amount_sum_{h}"] for h in ("5m", "15m", "1h")] == [300.0, 600.0, 1000.0]


def test_window_edges_and_ties(spark):
    rows = [dict(t=NOW - 60, amount=1), dict(t=NOW, amount=2), dict(t=NOW, amount=4)]
    got = by_id(W.velocity(tx(spark, rows)))
    assert got["t1"]["tx_count_1m"] == 1 and got["t2"]["tx_count_1m"] == 1  # lower bound in, ties out


def test_behavior_golden(spark):
    rows = [dict(t=NOW - 300, amount=100), dict(t=NOW - 200, amount=200), dict(t=NOW - 100, amount=300, category="dining"),
            dict(t=NOW, amount=400, category="Grocery")]
    got = by_id(P.features_32(tx(spark, rows)))["t3"]
    assert (got.user_avg_amount_30d, got.user_std_amount_30d, got.amount_zscore) == (200.0, 100.0, 2.0)
    assert got.user_category_frequency == 0.6667


def test_cold_start_and_single_prior(spark):
    got = by_id(P.features_32(tx(spark, [dict(t=NOW, amount=150), dict(t=NOW + 10, amount=300)])))
    first, second = got["t0"], got["t1"]
    assert (first.tx_count_1h, first.user_avg_amount_30d, first.user_std_amount_30d, first.amount_zscore) == (0, 150.0, 0.0, 0.0)
    assert (first.user_category_frequency, first.is_new_device, first.is_new_location, first.device_user_count_24h) == (1.0, 0, 0, 1)
    assert second.amount_zscore == 2.0  # (300 - 150) / 75


def test_device_location_and_speed(spark):
    rows = [dict(t=NOW, amount=1), dict(t=NOW + 60, amount=1, device_id="d2", latitude=11.0),
            dict(t=NOW + 120, amount=1, device_id="d1", customer_id="c2"),
            dict(t=NOW + 180, amount=1, device_id="d1", customer_id="c3")]
    got = by_id(P.features_32(tx(spark, rows)))
    assert (got["t1"].is_new_device, got["t1"].is_new_location) == (1, 1)
    assert got["t1"].distance_from_prev_loc_km == pytest.approx(111.19, abs=0.02)
    assert got["t1"].speed_kmh_from_prev_tx == pytest.approx(111.19 * 60, rel=1e-3)
    assert got["t3"].device_user_count_24h == 2


def brute_force(rows):
    """Straight from the definitions, quadratic."""
    def km(a, b):
        if (a["latitude"], a["longitude"]) == (0, 0) or (b["latitude"], b["longitude"]) == (0, 0):
            return 0.0
        p, q = math.radians(a["latitude"]), math.radians(b["latitude"])
        x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b["longitude"] - a["longitude"]) / 2) ** 2
        return 2 * 6371 * math.atan2(math.sqrt(x), math.sqrt(1 - x))
    out = {}
    for r in rows:
        mine = [o for o in rows if o["customer_id"] == r["customer_id"] and o["t"] < r["t"]]
        month = [o for o in mine if o["t"] >= r["t"] - 30 * 86400]
        placed = [o for o in month if o["latitude"] or o["longitude"]]
        dev = [o for o in rows if o["device_id"] == r["device_id"] and r["t"] - 86400 <= o["t"] < r["t"]]
        known = r["device_id"] != "unknown_device"
        out[r["transaction_id"]] = (
            sum(o["t"] >= r["t"] - 60 for o in mine), sum(o["t"] >= r["t"] - 3600 for o in mine),
            round(sum(o["amount"] for o in mine if o["t"] >= r["t"] - 900), 2),
            int(bool((r["latitude"] or r["longitude"]) and placed and min(km(r, o) for o in placed) > 50)),
            int(bool(known and any(o["device_id"] != "unknown_device" for o in month)
                     and all(o["device_id"] != r["device_id"] for o in month))),
            max(1, len({o["customer_id"] for o in dev})) if known else 1)
    return out


def skewed(n=400, seed=3):
    """A third of the rows belong to one customer, a fourth to one device; many ties."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        c = "c0" if i % 3 == 0 else f"c{rnd.randint(1, 30)}"
        far = rnd.random() < 0.3
        rows.append(dict(
            transaction_id=f"t{i}", customer_id=c, t=NOW + rnd.randint(0, 40 * 86400) // 30 * 30, amount=rnd.randint(1, 9000) / 100,
            device_id="d0" if i % 4 == 0 else rnd.choice(["unknown_device", f"d{rnd.randint(1, 9)}"]),
            latitude=0.0 if i % 11 == 0 else 10.0 + (rnd.randint(0, 8) if far else rnd.random() / 2),
            longitude=0.0 if i % 11 == 0 else -179.9 + rnd.random() / 3))
    for i in range(0, n, 5):  # bursts
        rows[i]["t"] = NOW + rnd.randint(0, 120)
    return rows


@pytest.mark.parametrize("limits", [Limits(), SPLIT_ALL, Limits(light=0, hot=0)])
def test_against_brute_force(spark, limits):
    rows = skewed()
    want = brute_force(rows)
    got = P.features_32(tx(spark, [{**r} for r in rows]), limits=limits).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.tx_count_1m, r.tx_count_1h, round(r.amount_sum_15m, 2), r.is_new_location, r.is_new_device,
                r.device_user_count_24h) == want[r.transaction_id], r.transaction_id


def test_hot_path_gives_every_feature(spark):
    df = tx(spark, skewed())
    pick = lambda limits: sorted(map(tuple, P.features_32(df, limits=limits).select("transaction_id", *FEATURES).collect()))
    assert pick(Limits()) == pick(SPLIT_ALL)


def test_no_look_ahead(spark):
    rows = skewed(120)
    cut = sorted(r["t"] for r in rows)[60]
    early = [r for r in rows if r["t"] <= cut]
    train = tx(spark, [{**r} for r in rows])  # same fitted frequencies
    pick = lambda some: {r.transaction_id: r for r in P.features_32(tx(spark, [{**r} for r in some]), train=train).collect()}
    before, after = pick(early), pick(rows)
    assert all(before[k] == after[k] for k in before)


def test_vector_faults(spark):
    df = P.features_32(tx(spark, [dict(t=NOW, amount=5)])).withColumn("log_amount", F.lit(float("nan")))
    assert P.vector_faults(df).first().bad_features == ["log_amount"]


def test_payment_codes(spark):
    df = spark.createDataFrame([("transfer",), ("WIRE",), (None,)], "p string")
    assert [r[0] for r in df.select(S.payment_code(F.col("p"))).collect()] == [0, 6, 6]


def test_velocity_and_probes_on_hot_keys(spark):
    df = tx(spark, skewed())
    probes = df.where("cast(substr(transaction_id, 2) as int) % 4 = 0").selectExpr("customer_id", "us + 5 as us", "transaction_id as probe")
    for run in (lambda lim: W.velocity(df, lim), lambda lim: A.velocity_at(df, probes, limits=lim),
                lambda lim: A.behavior_at(df, probes, limits=lim)):
        pick = lambda lim: sorted(map(repr, map(tuple, run(lim).select(*sorted(run(lim).columns)).collect())))
        assert pick(Limits()) == pick(SPLIT_ALL)
