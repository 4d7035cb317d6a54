import numpy as np

from riskspark.llm import queries, quality


def test_forest_learns_and_orders():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(3000, 4))
    y = ((x[:, 1] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    forest = quality.fit_forest(x[:2000], y[:2000], trees=40)
    assert ((forest.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95


def test_statistics_of_plain_cases():
    s = quality.statistics([b"", b"AB cd!\nAB cd!\n", "é# ".encode() * 1000])
    name = {n: i for i, n in enumerate(quality.STATISTICS)}
    assert (s[0] == 0).all()
    assert s[1, name["repeated_lines"]] == 0.5 and s[1, name["capital_words"]] == 0.5
    assert s[2, name["symbol_words"]] == 1 and s[2, name["distinct_words"]] == 1 / 1000


def test_held_out_accuracy(spark, sf):
    got = queries.QUERIES["op9_quality_trees"](spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id").query("held_out")
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert (both.predicted == both.quality).mean() > 0.9 and got.score.between(0, 1).all()


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 7), (1, "", 8), (None, "a b", 9), (2, "x" * 200_000, 1)], "doc_id long, text string, Score int")
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0), (9, 1, 0), (2, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    forest = quality.train(docs, labels)
    got = quality.score(docs, forest)
    assert got.columns == ["doc_id", "text", "score", "predicted"] and got.count() == 4
    blank = quality.train(docs.limit(0), labels.limit(0))
    assert [r.score for r in quality.score(docs, blank).collect()] == [0.5] * 4
    assert quality.score(docs.limit(0), blank).count() == 0


def naive_trees(x, y, trees, depth, rate=0.15, bins=64, ridge=1.0, least=5.0):
    """Boosting by loops over nodes, features and cuts: per tree a dict node -> (feature, cut), and leaf -> value."""
    mean = y.mean()
    margin, out = np.full(len(y), np.log(mean / (1 - mean))), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        splits, rows_of = {}, {0: np.arange(len(y))}
        for node in range(2**depth - 1):
            rows, best = rows_of[node], (1e-6, None)
            g_all, h_all = grad[rows].sum(), hess[rows].sum()
            for j in range(x.shape[1]):
                for cut in np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])):
                    left = rows[x[rows, j] <= cut]
                    g, h = grad[left].sum(), hess[left].sum()
                    if h >= least / 4 and h_all - h >= least / 4:
                        gain = g**2 / (h + ridge) + (g_all - g)**2 / (h_all - h + ridge) - g_all**2 / (h_all + ridge)
                        if gain > best[0] + 1e-12:
                            best = (gain, (j, cut))
            splits[node] = best[1]
            goes = x[rows, best[1][0]] > best[1][1] if best[1] else np.zeros(len(rows), bool)
            rows_of[2 * node + 1], rows_of[2 * node + 2] = rows[~goes], rows[goes]
        leaves = {k: -rate * grad[rows_of[k]].sum() / (hess[rows_of[k]].sum() + ridge) for k in range(2**depth - 1, 2**(depth + 1) - 1)}
        for k, v in leaves.items():
            margin[rows_of[k]] += v
        out.append((splits, leaves))
    return out


def test_splits_leaves_and_walk_against_loops():
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(300, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + rnd.normal(size=300) * 0.3 > 0.4).astype(float)
    forest, want = quality.fit_forest(x, y, trees=3, depth=2), naive_trees(x, y, 3, 2)
    new = rnd.normal(size=(50, 3))
    total = np.full(50, forest.base)
    for t, (splits, leaves) in enumerate(want):
        for node, split in splits.items():
            if split:
                assert (forest.feature[t, node], forest.threshold[t, node]) == split
        assert np.allclose(forest.leaf[t], [leaves[k] for k in sorted(leaves)])
        for i, row in enumerate(new):  # one row, one node at a time
            node = 0
            while node in splits:
                node = 2 * node + (2 if splits[node] and row[splits[node][0]] > splits[node][1] else 1)
            total[i] += leaves[node]
    assert np.allclose(forest.raw(new), total)


def test_texts_that_share_an_id_give_one_forest(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "zz " * 50), (2, "d e")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    fits = [quality.train(d, labels) for d in (docs, docs.orderBy(docs.text.desc()).coalesce(1), docs.repartition(5))]
    assert all((f.leaf == fits[0].leaf).all() and (f.threshold == fits[0].threshold).all() for f in fits)
