import random

import numpy as np
import pytest
import xxhash

from riskspark.llm import simhash

SCHEMA = "doc_id long, text string, fp string, Component_ID string"


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, near):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n
    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if near(a, b):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {n: top(n) for n in nodes}


def rows():
    rnd = random.Random(5)
    vocabulary = ["w%d" % i for i in range(300)]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.choice((1, 2, 3, 40, 200)))] for _ in range(30)]
    texts = [" ".join(b) for b in base]
    for b in base[:12]:
        for _ in range(6):
            c = list(b)
            c[rnd.randrange(len(c))] = rnd.choice(vocabulary)
            texts.append(" ".join(c))
    texts += [None, "", "  \n", "Ab cD", "ab CD", "ä b " * 9, "x " * 50_000] + [texts[0]] * 20
    return [(i, t, "x", "y") for i, t in enumerate(texts)] + [(0, texts[0], "x", "y"), (None, texts[3], "x", "y")]


@pytest.mark.parametrize("most", [16_384, 2])
def test_against_brute_force(spark, most):
    data = rows()
    got = simhash.near_duplicates(spark.createDataFrame(data, SCHEMA), most=most).collect()
    prints = {t: plain(t) for _, t, *_ in data}
    roots = groups(set(prints.values()), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for i, t, *_ in data:
        if i is not None:
            r = roots[prints[t]]
            least[r] = min(least.get(r, i), i)
    want = sorted((str(i), f"{prints[t]:016x}", least[roots[prints[t]]]) for i, t, *_ in data)
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want
    kept = simhash.keep_one(spark.createDataFrame(data, SCHEMA), most=most)
    assert kept.columns == ["doc_id", "text", "fp", "Component_ID"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))


def test_large_buckets_are_covered_again(spark):
    """Chains of small steps inside one bucket, far over the bound of a bucket."""
    rnd = random.Random(2)
    values, value = set(), 12345
    for _ in range(400):
        for _ in range(rnd.choice((1, 2, 3, 7))):
            value ^= 1 << rnd.randrange(20)
        values.add(value)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(sorted(values))], "doc_id long, fp long")
    want = groups(values, lambda a, b: (a ^ b).bit_count() <= 3)
    for most in (10_000, 8):
        got = {r.fp: r.component_id for r in simhash.classes(df, most=most).collect()}
        order = sorted(values)
        assert {v: order[c] for v, c in got.items()} == want


def test_every_close_pair_meets_in_a_table():
    rnd = random.Random(1)
    tables = simhash.masks(3)
    assert len(tables) == 15 and all(30 <= m.bit_count() <= 36 for m in tables)
    free = [(1 << 64) - 1]
    for level in range(simhash.LEVELS):
        free = {f & ~m for f in free for m in simhash.masks(3, level)}
    assert max(f.bit_count() for f in free) <= 8
    for _ in range(2000):
        x = rnd.getrandbits(64)
        y = x
        for b in rnd.sample(range(64), 3):
            y ^= 1 << b
        assert any(x & m == y & m for m in tables)


def test_empty_table_and_only_nameless_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    nameless = spark.createDataFrame([(None, "a b c", "x", "y")] * 3, SCHEMA)
    assert [r.text for r in simhash.keep_one(nameless).collect()] == ["a b c"]
    assert [r.component_id for r in simhash.near_duplicates(nameless).collect()] == [None] * 3


def test_forest_spans_components():
    values = np.array([0, 1, 3, 15, 255, 3 << 40], np.int64)
    a, b = simhash.forest_of(values, 1)
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(1, 0), (3, 0)]
