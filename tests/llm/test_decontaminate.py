import random

import numpy as np
import pytest

from riskspark.llm import decontaminate as dc

DOCS = "doc_id long, text string, Hits string, item_id int"


def brute_lcs(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
    return t[-1, -1]


def test_common_length():
    rnd = random.Random(0)
    for _ in range(200):
        a, b = ([rnd.choice([b"a", b"b", b"c"]) for _ in range(rnd.randrange(12))] for _ in "ab")
        assert dc.common_length(a, b) == brute_lcs(a, b)


def plants(seed=3):
    """400 items of a shared and a rare vocabulary, planted whole, altered, or not at all."""
    rnd = random.Random(seed)
    usual = ["of", "the", "and", "to", "in", "is", "it", "on"]
    word = lambda: rnd.choice(usual) if rnd.random() < 0.45 else "r%d" % rnd.randrange(6000)
    prose = lambda n: [word() for _ in range(n)]
    items = [prose(rnd.choice((15, 30, 59, 150))) for _ in range(400)]
    docs, whole, altered = [], set(), set()
    for d in range(500):
        text, kind = prose(rnd.choice((5, 60, 400))), d % 5
        if kind < 2:
            i = rnd.randrange(len(items))
            passage = list(items[i])
            if kind:
                for k in rnd.sample(range(len(passage) - 5), len(passage) // 5):
                    passage[k] = word()
            (altered if kind else whole).add((d, i))
            at = rnd.randrange(len(text))
            text = text[:at] + [w.upper() + "***" for w in passage] + text[at:]
        docs.append((d, " ".join(text), "x", 1))
    return docs, [(i, " ".join(x)) for i, x in enumerate(items)], whole, altered


def test_recall_and_precision(spark):
    docs, items, whole, altered = plants()
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(d, b).collect()}
    assert whole <= got and len(altered & got) >= 0.9 * len(altered)
    assert got <= whole | altered
    cleaned = dc.clean(d, b)
    assert cleaned.columns == ["doc_id", "text", "Hits", "item_id"]
    assert {r.doc_id for r in cleaned.collect()} == {x[0] for x in docs} - {x for x, _ in got}


@pytest.mark.parametrize("items", [[], [(None, None), (1, ""), (2, "!?")]])
def test_nothing_to_find(spark, items):
    d = spark.createDataFrame([(1, "a b c", "x", 1), (None, None, "x", 1), (2, "", "x", 1)], DOCS)
    b = spark.createDataFrame(items, "item_id long, text string")
    assert dc.contaminated(d, b).count() == 0 and dc.clean(d, b).count() == 3
    assert dc.clean(d.limit(0), b).count() == 0


def test_repeats_ties_answers_and_long_texts(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu. The answer is omega"
    d = spark.createDataFrame([(7, passage, "", 0), (7, passage, "", 0), (None, "x " * 90_000 + passage, "", 0), (8, "nothing of it", "", 0)], DOCS)
    b = spark.createDataFrame([(1, passage, "omega"), (1, passage, "omega"), (2, passage, None), (None, passage, "")],
                              "item_id long, text string, answer string")
    got = dc.contaminated(d, b, answer_col="answer").collect()
    assert sorted((str(r.doc_id), str(r.item_id)) for r in got) == sorted(
        (x, y) for x in ("7", "7", "None") for y in ("1", "2", "None"))
    assert all(r.lcs == 1 and r.answer == 1 for r in got)


@pytest.mark.parametrize("size,share", [(4, 0.5), (6, 0.1), (8, 0.1), (10, 0.34), (12, 0.1), (15, 0.34), (25, 0.5), (60, 0.34)])
def test_short_and_widely_shared_items(spark, size, share):
    """Verbatim items of one length, of which one is held by a large share of all documents."""
    rnd = random.Random(size)
    usual = ["of", "the", "and", "to", "in", "is", "it", "on"]
    word = lambda: rnd.choice(usual) if rnd.random() < 0.45 else "r%d" % rnd.randrange(6000)
    prose = lambda n: [word() for _ in range(n)]
    items = [prose(size) for _ in range(100)]
    while sum(w in usual for w in items[0]) > size // 2:
        items[0] = prose(size)
    docs, planted = [], set()
    for d in range(400):
        text = prose(rnd.choice((40, 120, 300)))
        for i in ({0} if d < 400 * share else set()) | ({rnd.randrange(1, 100)} if d % 2 else set()):
            at = rnd.randrange(len(text))
            text = text[:at] + items[i] + text[at:]
            if all(" ".join(items[j]) in " ".join(text) for j in [i, *[k for e, k in planted if e == d]]):
                planted.add((d, i))
        docs.append((d, " ".join(text), "x", 1))
    texts = {d: " ".join(t.split()) for d, t, *_ in docs}
    planted = {(d, i) for d, i in planted if " ".join(items[i]) in texts[d]}
    verbatim = {(d, i) for d in texts for i, x in enumerate(items) if f" {' '.join(x)} " in f" {texts[d]} "}
    b = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(spark.createDataFrame(docs, DOCS), b).collect()}
    assert len(planted & got) >= 0.95 * len(planted)
    assert len(got & verbatim) >= 0.95 * len(got)


def test_rounds_of_blocks_and_clashing_columns(spark, monkeypatch):
    docs, items, whole, altered = plants(seed=9)
    monkeypatch.setattr(dc, "BLOCK", 150)
    monkeypatch.setattr(dc, "ROUND", 2)
    d = spark.createDataFrame([(*r, "kept") for r in docs], DOCS + ", _hits string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(d, b).collect()}
    assert whole <= got <= whole | altered
    cleaned = dc.clean(d, b).collect()
    assert {r.doc_id for r in cleaned} == {x[0] for x in docs} - {x for x, _ in got} and {r["_hits"] for r in cleaned} == {"kept"}


def test_rounding_never_understates():
    rnd = np.random.default_rng(0)
    product = (rnd.normal(size=(50, 20)) ** 3).astype(np.float32)
    small, unit = dc.rounded_up(product)
    for _ in range(200):
        rows = rnd.integers(0, 50, 32)
        assert (small[rows].sum(axis=0) * unit >= product[rows].sum(axis=0) - 1e-3).all()
