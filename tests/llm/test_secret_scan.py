import base64
import hashlib
import random
import re

import duckdb
import pandas as pd
import pytest

from riskspark.llm import queries, secret_scan as ss

SCHEMA = "doc_id long, text string, SPANS int, base int"
ASSIGN = re.compile(r"""((?:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def brute(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{ss.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def texts():
    rnd = random.Random(1)
    parts = ["token", "Api_Key", "apikey", "passwd", "pAssword", " ", ":", "=", '"', "'", "AKIA", "AKIA1234567890AB", "abc", "deadbeef" * 4,
             "0" * 31, "a" * 40, "é", "𝛼", "\n", "x.y-z", "12345678", "secret"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randrange(40))) for _ in range(400)] + [None, "", "token=" + "b" * 100_000]


def test_base_spans_against_brute_force(spark):
    data = [(i, t, 1, 2) for i, t in enumerate(texts())]
    got = {r.doc_id: r for r in ss.scan(spark.createDataFrame(data, SCHEMA)).collect()}
    for i, t, *_ in data:
        assert got[i].base_sha256 == hashlib.sha256(brute(t).encode()).hexdigest(), t
        assert got[i].n_assign == brute(t).count("assign:")


def test_battery_finds_random_runs_only(spark):
    rnd = random.Random(4)
    syllable = ["tion", "the", "and", "er", "ing", "ment", "ate", "ly", "re", "con"]
    words = ["".join(rnd.choice(syllable) for _ in range(rnd.randrange(6, 12))) for _ in range(3000)]
    paths = ["/".join(rnd.choice(syllable) * 2 for _ in range(5)) for _ in range(500)]
    shouts = [w.upper() for w in words[:300]]
    keys = [base64.b64encode(rnd.randbytes(36)).decode() for _ in range(60)]
    keys += ["".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(56)) for _ in range(40)]
    orderly = ["0123456789" * 5, "abcdefghijklmnopqrstuvwxyz0123456789", "A1" * 30, "Z" * 40]
    lines = words + paths + shouts + orderly + keys
    rnd.shuffle(lines)
    got = ss.scan(spark.createDataFrame([(i, f"see {x} there", 1, 2) for i, x in enumerate(lines)], SCHEMA)).collect()
    hits = {lines[r.doc_id] for r in got if r.n_random}
    assert len(hits & set(keys)) >= 0.9 * len(keys)
    assert len(hits - set(keys)) <= 0.02 * len(hits)
    assert next(r for r in got if r.n_random).spans.startswith("random:4:")


def test_sql_says_the_same(spark):
    rnd = random.Random(9)
    keys = [base64.b64encode(rnd.randbytes(rnd.randrange(18, 60))).decode() for _ in range(80)]
    keys += [rnd.randbytes(rnd.randrange(10, 15)).hex() for _ in range(30)]
    words = ["".join(rnd.choice(["tion", "the", "er", "ment", "ING", "q"]) for _ in range(rnd.randrange(5, 14))) for _ in range(800)]
    data = [(i, f"{a} {b}, é {a}", 1, 2) for i, (a, b) in enumerate(zip(words, rnd.choices(keys + words, k=len(words)), strict=True))]
    data += [(10_000 + i, t, 1, 2) for i, t in enumerate(texts())] + [(None, "token=abcdefgh", 1, 2), (5, data[5][1], 1, 2)]
    df = spark.createDataFrame(data, SCHEMA)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(str(i), t) for i, t, *_ in data], columns=["doc_id", "text"]))
    want = sorted(tuple(map(str, r)) for r in con.execute(ss.oracle()).fetchall())
    columns = [c[0] for c in con.execute(ss.oracle()).description]
    got = ss.scan(df).select(columns).collect()
    assert sorted(tuple(map(str, r)) for r in got) == want
    assert sum(r.n_random for r in got) > 100


def test_redaction_and_edge_rows(spark):
    df = spark.createDataFrame([(1, 'é token = "abcdefgh12" AKIA1234567890AB.', 1, 2), (1, None, 1, 2), (None, "", 1, 2), (2, "clean", None, None)], SCHEMA)
    found = ss.with_spans(df)
    assert found.columns == ["doc_id", "text", "base", "spans"]
    out = [r[0] for r in found.select(ss.redacted(found["text"], found["spans"])).collect()]
    assert out == ['é [SECRET]" [SECRET].', None, "", "clean"]
    assert ss.scan(df.limit(0)).count() == 0


@pytest.mark.parametrize("table", ["documents"])
def test_query_has_no_python(spark, sf, table):
    df = queries.QUERIES["op1_secret_scan"](spark, sf)
    assert "Python" not in df._jdf.queryExecution().toString() and df.count() == spark.read.parquet(f"{sf}/{table}.parquet").count()
