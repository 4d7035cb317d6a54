"""Boosting on binned rows, the benchmark's columns and the size of the registered fits."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from riskspark.operators import ml as M
from riskspark.operators.boosting import Boosting, fit_together
from riskspark.plans import q_models as Q


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 4)).round(2)
    x[:, 3] = rng.integers(0, 3, 600)
    y = ((x[:, 0] * x[:, 1] > 0.2) ^ (x[:, 3] == 2)).astype(float)
    df = spark.createDataFrame([(*map(float, r), float(l)) for r, l in zip(x, y)], "a double, b double, c double, d double, label double")
    df = df.select(array_to_vector(F.array("a", "b", "c", "d")).alias("x"), "label", F.lit(1.0).alias("weight"))
    return df.repartition(3), x, y


@pytest.mark.parametrize("growth", ["level", "leaf", "symmetric"])
def test_trees_are_the_same_alone_and_spread(frame, growth):
    df, x, y = frame
    spec = Boosting(rounds=3, depth=3, rate=0.3, growth=growth, leaves=6, columns=0.75, l2=1.0, least=0.01, least_rows=2)
    alone, spread = fit_together([spec], df)[0], fit_together([spec], df, local_rows=0)[0]
    for a, b in zip(alone.trees, spread.trees, strict=True):
        assert all(np.array_equal(a[c], b[c]) for c in a)
    leaves = [int((t["left"] < 0).sum()) for t in alone.trees]
    assert max(leaves) <= (6 if growth == "leaf" else 8)
    p = np.array([r.p for r in M.probabilities(alone, df).select("p").collect()])
    assert ((p > 0) & (p < 1)).all()


def test_a_root_split_is_the_best_of_all(frame):
    df, x, y = frame
    t = Boosting(rounds=1, depth=1, rate=1.0, subsample=1.0, l2=1.0, least=0.0).fit(df).trees[0]
    p = y.mean()
    worth = lambda s: ((p - y)[s].sum()) ** 2 / (p * (1 - p) * s.sum() + 1.0)
    gains = {(c, v): worth(x[:, c] <= v) + worth(x[:, c] > v) for c in range(4) for v in np.unique(x[:, c])[:-1]}
    got = gains[int(t["column"][0]), float(t["cut"][0])]
    assert got >= 0.98 * max(gains.values())  # cuts are quantiles
    left = x[:, t["column"][0]] <= t["cut"][0]
    for side, rows in (("left", left), ("right", ~left)):
        want = -(p - y)[rows].sum() / (p * (1 - p) * rows.sum() + 1.0)
        assert t["value"][t[side][0]] == pytest.approx(want, abs=1e-4)


def test_benchmark_times_scoring_and_compares_datasets(frame):
    df, _, _ = frame
    rows = M.benchmark({"d0": (df, df), "d1": (df, df)}, {"boosted": M.boosted(3, 2, growth="level"), "other": M.boosted(2, 2, growth="symmetric")})
    out = M.compared(rows, ["pr_auc", "latency_ms"]).collect()
    assert len(out) == 4 and all(r.latency_ms > 0 for r in out)
    for r in out:
        pair = [o for o in out if o.model == r.model]
        assert r.mean_pr_auc == pytest.approx(sum(o.pr_auc for o in pair) / 2)
        assert {o.dataset: o.pr_auc for o in pair} == {"d0": r.pr_auc_d0, "d1": r.pr_auc_d1}


def test_a_benchmark_has_five_models_of_whole_size():
    models = Q.contenders(100)
    assert list(models) == ["logistic", "forest", "boosted", "leafwise", "symmetric"]
    assert (models["forest"].getStages()[0].getNumTrees(), models["forest"].getStages()[0].getMaxDepth()) == (100, 10)
    assert [models[m].rounds for m in ("boosted", "leafwise", "symmetric")] == [150, 150, 250]


def test_tuning_fits_whole_ensembles_over_the_space(spark, frame, monkeypatch):
    monkeypatch.setattr(Q, "modelling", lambda *a: (frame[0],) * 3)
    asked = {}
    monkeypatch.setattr(Q.M, "tune", lambda train, val, grid, build: asked.update(n=np.prod([len(v) for v in grid.values()]), rounds=build(**{k: v[0] for k, v in grid.items()}).rounds))
    Q.tune_grid(spark, "")
    assert asked["n"] >= 35 and asked["rounds"] == 250
