"""Many keys in one state record: every key on its own, against plain loops."""

import random

import pandas as pd
from pyspark.sql import functions as F

from riskspark.constants import DAY
from riskspark.sources.files import parse_messages
from riskspark.streaming import history as H
from riskspark.streaming import state as S
from tests.test_streaming import HOUR, MARK, Clock, brute, check, history_row, started


def test_customers_of_a_shard_do_not_see_each_other():
    rnd = random.Random(7)
    for rule in (None, lambda r: r["cents"] > 7 * 10**6 or r["tx_count_1h"] >= 3):
        p, _ = started(H.HistoryProcessor(blocked=rule))
        seen, at = {c: [] for c in ("c1", "c2", None)}, 100 * DAY
        for batch in range(6):
            rows = []
            for i in range(40):
                at += rnd.choice([0, HOUR // 4, HOUR, DAY])
                rows.append(history_row(f"{batch}-{i:02}", at, rnd) | {"customer_id": rnd.choice(list(seen))})
            got = {r["transaction_id"]: r for f in p.handleInputRows(("s",), [pd.DataFrame(rows)], Clock(MARK)) for r in f.to_dict("records")}
            for r in rows:
                mine = seen[r["customer_id"]]
                want = brute(r, mine if rule else mine + [x for x in rows if x["customer_id"] == r["customer_id"]])
                check(got[r["transaction_id"]], want)
                if rule and not rule(want | r):
                    mine.append(r)
            for r in [] if rule else rows:
                seen[r["customer_id"]].append(r)


def test_a_bucket_without_new_rows_keeps_its_totals():
    rnd = random.Random(3)
    p, _ = started(H.HistoryProcessor(blocked=lambda r: r["id"] != "tgood"))
    list(p.handleInputRows(("s",), [pd.DataFrame([history_row("good", 200 * DAY, rnd)])], Clock(MARK)))
    p.totals.updateValue = lambda *_: (_ for _ in ()).throw(AssertionError("unchanged totals are written"))
    got = pd.concat(p.handleInputRows(("s",), [pd.DataFrame([history_row("bad", 200 * DAY + 5, rnd)])], Clock(MARK)))
    assert got._n.tolist() == [1]


def test_devices_of_a_shard_against_a_loop():
    rnd = random.Random(9)
    p, _ = started(H.DeviceShardProcessor())
    seen, at, mark = set(), 100 * DAY, MARK
    for batch in range(6):
        rows = []
        for i in range(40):
            at += rnd.choice([0, HOUR, 5 * HOUR, DAY])
            rows.append(dict(transaction_id=f"{batch}-{i}", customer_id=rnd.choice(["a", "b", "c", None]), device=rnd.choice("de"),
                             us=max(mark, at - rnd.choice([0, 20 * HOUR])), member=True))
        seen |= {(r["device"], r["customer_id"], r["us"]) for r in rows}
        got = pd.concat(p.handleInputRows(("s",), [pd.DataFrame(rows)], Clock(mark)))
        got = dict(zip(got.transaction_id, got.users))
        for r in rows:
            assert got[r["transaction_id"]] == len({c for d, c, us in seen if d == r["device"] and r["us"] - DAY <= us < r["us"]})
        mark = max(mark, at - DAY)


def test_mandates_of_a_shard():
    p, _ = started(S.MandateProcessor())
    attempt = lambda m, i, day, amount=1.0: dict(mandate_id=m, attempt_id=i, us=day * DAY, amount=amount, max_amount=5.0, frequency="WEEKLY",
                                                 status="ACTIVE", expires_us=100 * DAY)
    run = lambda *rows: pd.concat(p.handleInputRows(("s",), [pd.DataFrame(rows)], None)).set_index("attempt_id").reject_reason.to_dict()
    assert run(attempt("a", 1, 1), attempt("b", 2, 2), attempt("a", 3, 3), attempt("b", 4, 3, 9.0)) == {1: None, 2: None, 3: "TOO_EARLY", 4: "OVER_CEILING"}
    assert run(attempt("a", 5, 8), attempt("b", 6, 8), attempt("b", 7, 101)) == {5: None, 6: "TOO_EARLY", 7: "EXPIRED"}


def test_holds_of_a_shard():
    p, handle = started(S.HoldProcessor())
    made = lambda h, us: dict(hold_id=h, us=us, seq=0, action="CREATE", token_ok=True, expires_us=us + 300)
    act = lambda h, us, what, ok=True: dict(hold_id=h, us=us, seq=1, action=what, token_ok=ok, expires_us=None)
    run = lambda *rows: [tuple(x) for f in p.handleInputRows(("s",), [pd.DataFrame(rows)], Clock(0)) for x in f.to_numpy()]
    assert run(made("a", 1000), made("b", 9000), act("b", 9100, "DENY"), made("c", 5000), act("a", 1001, "CONFIRM", False)) == [("b", "DENIED")]
    assert handle.timers == [2]
    fire = lambda us: [tuple(x) for f in p.handleExpiredTimer(("s",), Clock(us), None) for x in f.to_numpy()]
    assert fire(2000) == [("a", "EXPIRED")] and handle.timers == [2, 6]
    assert run(act("b", 9200, "CONFIRM"), act("c", 5100, "CONFIRM")) == [("c", "RELEASED")]
    assert fire(10_000) == [] and not p.holds.exists() and not p.timer.exists()


def test_a_message_is_decoded_once(spark):
    df = spark.createDataFrame([(1, '{"transaction_id": " a ", "customer_id": "c", "merchant_id": "m", "timestamp": 1, "amount": 2}'), (2, None), (3, "{")], "n int, payload string")
    out = parse_messages(df)
    for part in (out.where("valid"), out.where("reject_reason = 'malformed'")):
        assert part._jdf.queryExecution().optimizedPlan().toString().lower().count("from_json") == 1
    assert [(r.n, r.transaction_id, r.reject_reason) for r in out.orderBy("n").collect()] == [(1, "a", None), (2, None, "malformed"), (3, None, "malformed")]
