"""Streams against batch; their keyed processors against plain loops, late rows, silence and eviction included."""

import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.constants import DAY, FEATURES
from riskspark.operators import fusion as U
from riskspark.plans import features as P
from riskspark.streaming import history as H
from riskspark.streaming import jobs as J
from tests.helpers import tx
from tests.test_features import NOW, skewed

CUTS = [(NOW + 10 * 86400) * 1_000_000, (NOW + 25 * 86400) * 1_000_000]
HOUR = 3_600_000_000
MARK = 0  # no watermark yet


class MapState:
    def __init__(self):
        self.held, self.read = {}, []

    def exists(self):
        return bool(self.held)

    def iterator(self):
        return iter(list(self.held.items()))

    def getValue(self, key):
        self.read.append(key)
        return self.held.get(key)

    def updateValue(self, key, value):
        self.held[key] = value

    def removeKey(self, key):
        self.held.pop(key, None)

    def clear(self):
        self.held = {}


class ValueState:
    held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


class Handle:
    def __init__(self):
        self.timers = []

    def getMapState(self, *_):
        return MapState()

    def getValueState(self, *_):
        return ValueState()

    def registerTimer(self, ms):
        self.timers.append(ms)


class Clock:
    def __init__(self, us):
        self.us = us

    def getCurrentWatermarkInMs(self):
        return self.us // 1000


def started(processor):
    handle = Handle()
    processor.init(handle)
    return processor, handle


def history_row(i, us, rnd):
    y, x = rnd.choice([(10.0, 20.0), (10.3, 20.0), (40.0, 60.0), (0.0, 0.0)])
    return dict(transaction_id=f"t{i}", customer_id="c", us=us, cents=rnd.randrange(1, 10**7), hour=rnd.randrange(24),
                cat=rnd.choice("ab"), dev=rnd.choice(["d1", "d2", "", "unknown_device"]), lat=y, lon=x, member=True)


def brute(r, seen):
    """Window values of a row given all rows of the history."""
    month = sorted((p for p in seen if r["us"] - H.MONTH <= p["us"] < r["us"]), key=lambda p: (p["us"], p["transaction_id"]))
    placed = [p for p in month if p["lat"] or p["lon"]]
    own = [p for p in month if p["dev"] == r["dev"]]
    out = {f"tx_count_{h}": sum(p["us"] >= r["us"] - n for p in month) for h, n in H.W.SHORT.items()}
    out |= {f"_cents_{h}": sum(p["cents"] for p in month if p["us"] >= r["us"] - H.W.SHORT[h]) for h in H.W.SUMMED}
    out |= dict(_n=len(month), _sum=sum(p["cents"] for p in month), _hours=sum(p["hour"] for p in month),
                _same_cat=sum(p["cat"] == r["cat"] for p in month), _same_dev=len(own), _squares=sum(p["cents"] ** 2 for p in month),
                _devices=sum(p["dev"] not in ("", "unknown_device") for p in month), _placed=bool(placed))
    for name, rows in (("any", month), ("own", own)):
        out |= {f"_{name}_{c}": rows[-1][c] if rows else None for c in ("us", "lat", "lon")}
    out["_near"] = bool((r["lat"] or r["lon"]) and any(H.km(r["lat"], r["lon"], p["lat"], p["lon"]) <= 50 for p in placed))
    return out


def check(got, want):
    for c, v in want.items():
        assert (pd.isna(got[c]) and v is None) or got[c] == v, (c, got[c], v)


@pytest.mark.parametrize("evict", [False, True])
def test_history_over_buckets_against_a_loop(evict):
    rnd = random.Random(5)
    rule = (lambda r: r["cents"] > 7 * 10**6 or r["tx_count_1h"] >= 3) if evict else None
    p, _ = started(H.HistoryProcessor(blocked=rule))
    seen, at, mark = [], 100 * DAY, MARK
    for batch in range(12):
        rows = []
        for i in range(rnd.randrange(1, 25)):
            at += rnd.choice([0, HOUR // 4, HOUR, 9 * HOUR, DAY])
            rows.append(history_row(f"{batch}-{i:02}", max(mark, at - rnd.choice([0, 0, 20 * HOUR])), rnd))
        got = {r["transaction_id"]: r for r in pd.concat(p.handleInputRows(("c",), [pd.DataFrame(rows)], Clock(mark))).to_dict("records")}
        assert len(got) == len(rows)
        for r in sorted(rows, key=lambda r: (r["us"], r["transaction_id"])):
            if evict:
                want = brute(r, seen)
                if not rule(want | r):
                    seen.append(r)
            else:
                want = brute(r, seen + rows)
            check(got[r["transaction_id"]], want)
        seen += [] if evict else rows
        mark = max(mark, at - DAY)


def test_a_row_reads_few_buckets():
    rnd = random.Random(1)
    p, _ = started(H.HistoryProcessor())
    for day in range(28):
        list(p.handleInputRows(("c",), [pd.DataFrame([history_row(day, (100 + day) * DAY + 5 * HOUR, rnd)])], Clock(MARK)))
    p.rows.read = []
    list(p.handleInputRows(("c",), [pd.DataFrame([history_row(99, 128 * DAY + HOUR // 2, rnd)])], Clock(MARK)))
    assert sorted(k[0] for k in p.rows.read) == [98, 127, 128]  # where the month begins, the last hour's two


def test_late_and_repeated_rows_leave_no_trace():
    rnd = random.Random(2)
    p, _ = started(H.HistoryProcessor())
    a, b = history_row("a", 200 * DAY, rnd), history_row("b", 200 * DAY + HOUR // 2, rnd)
    list(p.handleInputRows(("c",), [pd.DataFrame([a])], Clock(MARK)))
    old = history_row("old", 198 * DAY, rnd)
    got = {r["transaction_id"]: r for r in pd.concat(p.handleInputRows(("c",), [pd.DataFrame([a, old, b, b])], Clock(199 * DAY))).to_dict("records")}
    assert {i: (r["late"], r["repeat"]) for i, r in got.items()} == {"ta": (False, True), "told": (True, False), "tb": (False, False)}
    assert got["tb"]["_n"] == 1 and sum(len(v[0]) for v in p.rows.held.values()) == 2


def test_an_evicted_row_is_known_but_not_seen():
    rnd = random.Random(3)
    p, _ = started(H.HistoryProcessor(blocked=lambda r: r["id"] == "bad"))
    bad = history_row("x", 200 * DAY, rnd) | {"transaction_id": "bad"}
    list(p.handleInputRows(("c",), [pd.DataFrame([bad])], Clock(MARK)))
    got = pd.concat(p.handleInputRows(("c",), [pd.DataFrame([bad, history_row("y", 200 * DAY + 5, rnd)])], Clock(MARK))).set_index("transaction_id")
    assert got["repeat"].to_dict() == {"bad": True, "ty": False} and got._n["ty"] == 0


def test_silence_clears_the_state():
    rnd = random.Random(4)
    p, handle = started(H.HistoryProcessor())
    for day in (100, 110):
        list(p.handleInputRows(("c",), [pd.DataFrame([history_row(day, day * DAY, rnd)])], Clock(MARK)))
    assert handle.timers == [(130 * DAY) // 1000]
    list(p.handleExpiredTimer(("c",), Clock(130 * DAY), None))  # a newer row came meanwhile: sleep on
    assert p.rows.held and handle.timers[-1] == (140 * DAY) // 1000
    list(p.handleExpiredTimer(("c",), Clock(140 * DAY), None))
    assert not p.rows.held and not p.totals.held and not p.clock.exists()

    d, handle = started(H.DeviceProcessor())
    frame = pd.DataFrame([dict(transaction_id="t", customer_id="c1", us=50 * HOUR, member=True)])
    list(d.handleInputRows(("d",), [frame], Clock(MARK)))
    list(d.handleExpiredTimer(("d",), Clock(handle.timers[0] * 1000), None))
    assert not d.users.held and not d.clock.exists()


def uses(processor, mark, *rows):
    frame = pd.DataFrame([dict(transaction_id=f"t{i}", customer_id=c, us=int(h * HOUR), member=True) for i, (c, h) in enumerate(rows)])
    return pd.concat(processor.handleInputRows(("d",), [frame], Clock(int(mark * HOUR)))).users.tolist()


def test_late_device_use_neither_sees_nor_hides_later_ones():
    p, _ = started(H.DeviceProcessor())
    assert uses(p, 0, ("c1", 100)) == [0]
    assert uses(p, 76, ("c1", 90)) == [0]
    assert uses(p, 76, ("c2", 120)) == [1]
    assert uses(p, 94, ("c3", 95)) == [1]
    assert uses(p, 999, ("c4", 1000), ("c5", 5)) == [0]  # the second is older than the watermark
    assert list(p.users.held) == [("c4",)]


def test_stream_of_all_features_equals_batch(spark):
    """Hot customer and device in lanes; days between slices, so that windows span many buckets."""
    df = tx(spark, skewed(240))
    lane = lambda c, hot: F.when(F.col(c) == hot, 3).otherwise(1)
    frequency = P.category_frequency(df)
    got = J.replay(df, "us", CUTS, "t-features", lambda s: H.feature_parts(s, lanes=lane("customer_id", "c0"), device_lanes=lane("device_id", "d0")),
                   lambda batch: H.finish(H.merge_parts(batch), frequency))
    pick = lambda d: sorted(map(tuple, d.select("transaction_id", *FEATURES).collect()))
    assert pick(got) == pick(P.features_32(df))


def test_deciding_stream(spark):
    """Broken, repeated and late messages each take their route; the rest is decided as in batch, once."""
    rows = skewed(60)
    df = tx(spark, rows)
    seconds = {r["transaction_id"]: r["us"] for r in df.select("transaction_id", "us").collect()}
    payload = F.to_json(F.struct(*[c for c in df.columns if c not in ("us", "amount")], F.col("amount").cast("double").alias("amount"),
                                 (F.col("us") / 1e6).alias("timestamp")))
    good = df.select("us", payload.alias("payload"))
    first = min(seconds.values())
    stale = json.dumps(dict(transaction_id="stale", customer_id="c0", merchant_id="m", timestamp=first / 1e6 - 5 * 86400, amount=3.0, origin_balance=1.0))
    extra = spark.createDataFrame([(CUTS[1] + 1, stale), (CUTS[0], "{broken"), (CUTS[1], '{"transaction_id": "  "}')], "us long, payload string")
    mark = max(us for us in seconds.values() if us < CUTS[1]) - DAY  # the watermark of the last slice
    again = good.where((F.col("us") < CUTS[0]) | F.col("us").between(mark, CUTS[1] - 1)).withColumn("us", F.lit(CUTS[1]))
    messages = good.unionByName(again).unionByName(extra)
    frequency = P.category_frequency(df)
    score = lambda d: U.score_transactions(d, F.lit(0.6), F.lit(0.2))
    more = T.StructType([T.StructField("home_latitude", T.DoubleType()), T.StructField("home_longitude", T.DoubleType())])
    root = J.arrive(messages, "us", CUTS, "t-decide", lambda s, ckpt, out: J.decide_messages(s.select("payload"), score, frequency, out, ckpt, more))
    want = {r.transaction_id: r for r in score(P.features_32(df)).collect()}
    got = J.read_route(spark, root, "decisions").collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r.transaction_id]
        assert (r.risk_score, r.decision, r.risk_level, r.reasons) == (w.risk_score, w.decision, w.risk_level, w.reasons)
        assert json.loads(r.event_json)["transaction_id"] == r.transaction_id
    alerts = [r.key for r in J.read_route(spark, root, "alerts").collect()]
    assert sorted(alerts) == sorted(i for i, w in want.items() if w.decision == "BLOCK" or w.hard_block)
    assert {r.transaction_id for r in J.read_route(spark, root, "late").collect()} == {"stale", *(i for i, us in seconds.items() if us < CUTS[0])}
    repeats = {i for i, us in seconds.items() if mark <= us < CUTS[1]}
    assert repeats and {r.transaction_id for r in J.read_route(spark, root, "repeat").collect()} == repeats
    assert sorted(r.reason for r in J.read_route(spark, root, "dead").collect()) == ["empty transaction_id", "malformed"]


def test_impossible_travel():
    row = dict(_own_us=None, _own_lat=None, _own_lon=None, _any_us=0, _any_lat=10.0, _any_lon=20.0, dev="d", placed=1, us=HOUR, lat=20.0, lon=20.0)
    assert H.impossible_travel(row) and not H.impossible_travel(row | dict(us=2 * HOUR))
    assert not H.impossible_travel(row | dict(placed=0)) and not H.impossible_travel(row | dict(_any_us=None))
    assert H.impossible_travel(row | dict(us=3 * HOUR, _own_us=2 * HOUR, _own_lat=10.0, _own_lon=20.0)) and np.isfinite(row["lat"])
