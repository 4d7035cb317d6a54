"""Distributed order, metrics, drift and sinks."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from riskspark.operators import distsort as O
from riskspark.operators import drift as D
from riskspark.operators import evaluate as E
from riskspark.session import work_path
from riskspark.sources.sinks import KeyedLog


def test_row_numbers_and_thresholds(spark):
    values = random.Random(2).sample(range(10_000), 500)
    df = spark.createDataFrame([(v, v % 3) for v in values], "v bigint, g int").repartition(7)
    got = {r.v: r.rn for r in O.global_row_number(df, [F.col("v")]).collect()}
    assert got == {v: i + 1 for i, v in enumerate(sorted(values))}
    per = O.global_row_number(df, [F.col("v").desc()], group=["g"]).collect()
    for g in range(3):
        want = sorted((v for v in values if v % 3 == g), reverse=True)
        assert {r.v: r.rn for r in per if r.g == g} == {v: i + 1 for i, v in enumerate(want)}
    for rank in (0, 17, 499):
        assert O.rank_threshold(df, "v", rank, buckets=8)[0] == sorted(values)[rank]


def test_quantiles_of_a_hot_group(spark):
    rnd = random.Random(4)
    rows = [("a" if i % 3 else "b", float(rnd.randint(0, 40))) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {(r.g, r.prob): r.value for r in O.quantiles(df, "x", [0.0, 0.1, 0.5, 0.95, 1.0], ["g"]).collect()}
    for g in "ab":
        x = np.array([v for k, v in rows if k == g])
        for p in (0.0, 0.1, 0.5, 0.95, 1.0):
            assert abs(got[g, p] - np.quantile(x, p)) < 1e-9


def test_split_70_15_15(spark):
    df = spark.createDataFrame([(f"t{i:03d}", i * 10) for i in range(100)], "transaction_id string, us bigint")
    got = E.split_temporal(df).groupBy("split").agg(F.count("us").alias("n"), F.min("us").alias("a"), F.max("us").alias("b"))
    got = {r.split: (r.n, r.a, r.b) for r in got.collect()}
    assert got == {"train": (70, 0, 690), "val": (15, 700, 840), "test": (15, 850, 990)}


def test_split_of_ties(spark):
    df = spark.createDataFrame([(f"t{i:03d}", 5) for i in range(40)], "transaction_id string, us bigint")
    assert {r.split: r["count"] for r in E.split_temporal(df).groupBy("split").count().collect()} == {"train": 28, "val": 6, "test": 6}


def test_metrics_by_hand(spark):
    rnd = random.Random(9)
    y = [rnd.random() < 0.3 for _ in range(300)]
    p = [round(min(1, max(0, 0.3 * t + rnd.random() * 0.7)), 2) for t in y]
    df = spark.createDataFrame([(int(t), s) for t, s in zip(y, p)], "label int, p double")
    got = E.ranking_metrics(E.curve(df)).first()
    pos, neg = [s for t, s in zip(y, p) if t], [s for t, s in zip(y, p) if not t]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert abs(got.roc_auc - auc) < 1e-4
    step, last = 0.0, 0
    for t in sorted(set(p), reverse=True):
        tp, n = sum(s >= t for s in pos), sum(s >= t for s in p)
        step += (tp - last) * tp / n / len(pos)
        last = tp
    assert abs(got.avg_precision - step) < 1e-4


def test_undersample_is_exact_and_whole(spark):
    df = spark.createDataFrame([(f"t{i}", int(i % 10 == 0)) for i in range(500)], "transaction_id string, label int")
    got = E.undersample(df, ratio=3.0)
    counts = {r.label: r["count"] for r in got.groupBy("label").count().collect()}
    assert counts == {1: 50, 0: 150} and got.distinct().count() == 200


def test_drift_stable_and_shifted(spark):
    rng = np.random.default_rng(1)
    frame = lambda m, s: spark.createDataFrame(pd.DataFrame({"x": rng.normal(m, s, 1000), "c": 1.0}))
    ref = frame(100, 15)
    assert {r.feature: r.severity for r in D.psi(ref, frame(100, 15), ["x", "c"]).collect()} == {"x": "STABLE", "c": "STABLE"}
    shifted = D.psi(ref, frame(150, 20), ["x"])
    assert shifted.first().severity == "SIGNIFICANT_DRIFT" and D.assess(shifted).first().status == "SIGNIFICANT_DRIFT"


def test_keyed_log(spark):
    log = KeyedLog(spark, work_path(spark, "log"), "id", update=["status"], coalesce=["label"])
    row = lambda i, s, st, l: spark.createDataFrame([(i, s, st, l)], "id string, score double, status string, label int")
    log.append(row("a", 1.0, "NEW", 1), 0, "score")
    log.append(row("a", 2.0, "DONE", None).unionByName(row("a", 1.5, "BUSY", None)), 1, "score")
    log.append(row("a", 2.0, "DONE", None).unionByName(row("a", 1.5, "BUSY", None)), 1, "score")  # a repeated batch replaces itself
    got = log.snapshot().collect()
    assert len(got) == 1 and (got[0].score, got[0].status, got[0].label) == (1.0, "DONE", 1)


def test_row_id_of_many_files(spark):
    path = work_path(spark, "rows")
    spark.range(0, 1000, 1, 6).write.parquet(path)
    got = O.file_row_number(spark.read.parquet(path)).select("row_number").collect()
    assert sorted(r[0] for r in got) == list(range(1000))
