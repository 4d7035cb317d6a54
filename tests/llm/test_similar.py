import random

import pytest
from pyspark.sql import functions as F

from riskspark.llm import similar


def grams(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i:i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute(texts):
    """Smallest id of every component; links by exact similarity of all pairs."""
    sets = {i: grams(t) for i, t in texts.items()}
    root = {i: i for i in texts}
    for a in texts:
        for b in texts:
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if b < a and (not either or both >= 0.8 * either) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return set(root.values())


def planted(seed=1):
    """Lone texts, chains of edits (neighbours link, ends do not) and a large group around one text."""
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(900)]
    texts = [" ".join(draw.choices(words, k=draw.randint(3, 200))) for _ in range(60)]
    for _ in range(6):
        now = draw.choices(words, k=150)
        for _ in range(8):
            texts.append(" ".join(now))
            now = list(now)
            for _ in range(3):
                now[draw.randrange(len(now))] = draw.choice(words)
    base = draw.choices(words, k=180)
    for _ in range(80):
        now = list(base)
        for _ in range(draw.randint(0, 4)):
            now[draw.randrange(len(now))] = draw.choice(words)
        texts.append(" ".join(now))
    texts += ["", None, "one", "One ", "a b c d", texts[0], texts[0].upper()]
    draw.shuffle(texts)
    return dict(enumerate(texts))


@pytest.mark.parametrize("block,peel", [(500_000, 2_000_000), (1_500, 10**9), (3_000, 6_000)])
def test_against_all_pairs(spark, block, peel):
    texts = planted()
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, `key` string")
    got = similar.keep_one(docs, block=block, peel=peel)
    assert got.columns == docs.columns
    ids = [r.doc_id for r in got.collect()]
    assert len(ids) == len(set(ids)) and set(ids) == brute(texts)


def test_forest_of_a_block():
    import numpy as np
    sets = [np.arange(0, 100), np.arange(5, 105), np.arange(10, 110), np.arange(500, 520), np.arange(15, 115)]
    edges = similar.forest_of([b"a", b"b", b"c", b"d", b"e"], sets, 0.9)
    assert sorted(edges) == [(b"b", b"a"), (b"c", b"a"), (b"e", b"a")]


def test_nulls_repeats_and_empty_table(spark):
    schema = "doc_id long, text string, _row int, _key int, _id int"
    long = " ".join(f"w{i}" for i in range(300_000))
    rows = [(1, "a b c d e f", 1, 1, 1), (1, "a b c d e f", 1, 1, 1), (1, "other words", 2, 2, 2), (None, "only here", 3, 3, 3),
            (None, "only here", 3, 3, 3), (None, "A b c d e f", 4, 4, 4), (5, None, 5, 5, 5), (4, "", 6, 6, 6), (None, None, 7, 7, 7), (8, long, 8, 8, 8), (9, long + " x", 9, 9, 9)]
    got = similar.keep_one(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or 0, r._row) for r in got) == [(0, 3), (1, 1), (1, 2), (4, 6), (8, 8)]
    empty = spark.createDataFrame([], schema)
    assert similar.keep_one(empty).count() == 0 and similar.keep_one(empty).columns == empty.columns


def test_given_documents_recall(spark, sf):
    """The stage's groups on the given table against exact similarity over an inverted index."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    holders, pairs = {}, set()
    sets = {i: grams(t) for i, t in texts.items()}
    for i, g in sets.items():
        for x in g:
            holders.setdefault(x, []).append(i)
    for ids in holders.values():
        pairs.update((a, b) for a in ids for b in ids if a < b)
    near = {(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    points, named = similar.classes(docs)
    root = {r.id: r.root for r in points.join(named.drop("id"), "key").select("id", F.hex("root").alias("root")).collect()}
    assert sum(root[a] == root[b] for a, b in near) >= 0.99 * len(near)
