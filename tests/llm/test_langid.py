import numpy as np

from riskspark.llm import common, langid, queries

SCHEMA = "doc_id long, text string, lang string, Score string, LANG_PRED int"


def test_backpropagation_matches_differences():
    rnd = np.random.default_rng(0)
    net = langid.start_network(["a", "b"])
    table, recurrent = (x.astype(np.float64) for x in (net.tables[0], net.recurrent[0]))
    ids = rnd.integers(0, 256, (5, 3))
    want = rnd.normal(size=(5, langid.HIDDEN, 3))
    real, langid.np.zeros = np.zeros, lambda s, d=float: real(s, float if d is np.float32 else d)
    try:
        loss = lambda: sum((h * w).sum() for h, w in zip(langid.run_direction(table, recurrent, ids), want, strict=True))
        steps = list(langid.run_direction(table, recurrent, ids, keep=True))
        grads = langid.backward(table, recurrent, ids, steps, want)
        for p, g in zip((table, recurrent), grads, strict=True):
            for _ in range(30):
                at = (rnd.integers(p.shape[0]), ids[rnd.integers(5), rnd.integers(3)] if p is table else rnd.integers(p.shape[1]))
                keep, eps = p[at], 1e-5
                p[at] = keep + eps
                high = loss()
                p[at] = keep - eps
                low = loss()
                p[at] = keep
                assert abs((high - low) / (2 * eps) - g[at]) < 1e-5
    finally:
        langid.np.zeros = real


def test_every_position_of_long_and_short_texts_counts():
    net = langid.start_network(["a", "b", "c"])
    texts = [b"", b"x", b"hello " * 100, b"y" * langid.WINDOW, b"z" * (langid.WINDOW + 1)]
    got = langid.pooled(net, texts)
    for text, row in zip(texts, got, strict=True):
        parts = [langid.position_probabilities(net, np.frombuffer(text[k:k + langid.WINDOW].ljust(langid.WINDOW, b"\0"), np.uint8)[:, None].astype(int))
                 [:len(text) - k, :, 0] for k in range(0, len(text), langid.WINDOW)]
        want = np.concatenate(parts).mean(axis=0) if parts else 0
        assert np.allclose(row, want, atol=1e-5)


def test_held_out_accuracy(spark, sf):
    got = queries.QUERIES["op2_byte_gru_language"](spark, sf).toPandas()
    truth = spark.read.parquet(f"{sf}/documents.parquet").toPandas()[["doc_id", "lang"]]
    both = truth.merge(got, on="doc_id")
    assert len(both) == len(got) == len(truth) and got.score.between(0, 1).all()
    held = both[both.held_out]
    assert 0.2 < len(held) / len(both) < 0.5 and (held.lang == held.lang_pred).mean() > 0.9


def test_edge_rows(spark):
    rows = [(1, None, "en", "x", 1), (2, "", "en", "x", 1), (2, "123 !?", "en", "x", 1), (None, "éé", None, "x", 1), (3, "a" * 200_000, "de", "x", 1)]
    rows += [(i, "some words", "de", "x", 1) for i in range(4, 12)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = langid.identify(df, langid.train(df, epochs=1))
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    assert [r.lang_pred == "und" for r in got.collect()] == [True, True, True] + [False] * 10
    nothing = langid.train(df.limit(0))
    assert {(r.lang_pred, r.score) for r in langid.identify(df, nothing).collect()} == {("und", 0.0)}
    assert langid.identify(df.limit(0), nothing).count() == 0 and common.fold(df["doc_id"], 3) is not None
