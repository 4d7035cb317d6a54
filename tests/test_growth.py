"""Work that must not grow faster than the rows: frames, passes over scored rows, carried columns, batches."""

import datetime as dt
import re

import pyarrow as pa
from pyspark.sql import functions as F, types as T

from riskspark.llm import common, pieces
from riskspark.operators import evaluate as E
from riskspark.operators import ml as M
from riskspark.operators import windows as W
from riskspark.plans import q_models


def counted(spark, df, column, kind="double"):
    """``df`` with a column passed through a step that counts its rows."""
    seen = spark.sparkContext.accumulator(0)

    def step(x):
        seen.add(1)
        return x
    return df.withColumn(column, F.udf(step, kind, useArrow=False).asNondeterministic()(column)), seen


def test_a_window_total_is_the_difference_of_two_growing_frames(spark):
    rows = [("a", us, x) for us, x in ((0, 1), (5, 2), (5, None), (10, 4), (11, 8), (40, 16))] + [("a", None, 32), ("a", None, 64), ("b", 5, 128)]
    df = spark.createDataFrame(rows, "k string, us long, x long")
    out = df.withColumns({"n": W._slide(F.count(F.lit(1)), ["k"], 10), "s": W._slide(F.sum("x"), ["k"], 10)})
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "RangeFrame, unboundedpreceding" in plan and not re.search(r"RangeFrame, -\d", plan)
    for row in out.collect():
        if row.us is None:
            inside = [r for r in rows if r[0] == row.k and r[1] is None]
        else:
            inside = [r for r in rows if r[0] == row.k and r[1] is not None and row.us - 10 <= r[1] < row.us]
        assert (row.n, row.s) == (len(inside), sum(r[2] or 0 for r in inside))


def test_metrics_score_every_row_once(spark):
    df = spark.createDataFrame([(i % 2, i / 40) for i in range(40)], "label int, p double")
    scored, seen = counted(spark, df, "p")
    assert M.evaluated(scored).count() == 1
    assert seen.value == 40


def test_cut_points_read_the_rows_once(spark):
    df = spark.createDataFrame([(i // 3, f"t{i:03d}") for i in range(60)], "us long, transaction_id string")
    read, seen = counted(spark, df, "us", "long")
    split = E.split_temporal(read)
    assert seen.value == 60
    assert {r.split: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 42, "val": 9, "test": 9}


def test_model_frames_carry_what_fits_read(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    events = [(i, start + dt.timedelta(hours=i), i % 4, "click", 10.0 + i, '{"k": %d}' % (i % 30)) for i in range(80)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(i, 100.0 * i) for i in range(4)], "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    frames = q_models.modelling(spark, str(tmp_path))
    assert [f.count() for f in frames] == [56, 12, 12]
    assert frames[0].columns == ["transaction_id", "event_id", "split", "x", "label", "weight"]


def test_a_slice_of_texts_is_an_output_batch():
    column = pa.array(["a" * 3_000_000, None, "b" * 3_000_000, "", "c" * 9_000_000, "d"])
    sizes = common.text_udf(lambda t: pa.array([len(x) for x in t], pa.int64()), T.LongType())
    got = list(sizes.func(iter([column, column.slice(1, 1), column.slice(0, 0)])))
    assert [b.to_pylist() for b in got] == [[3_000_000, 0], [3_000_000, 0], [9_000_000], [1], [0]]
    ids = pieces._udf(lambda t: pa.array([len(x) for x in t], pa.int64()), T.LongType(), pieces.model_path())
    assert [len(b) for b in ids.func(iter([column]))] == [2, 2, 1, 1]
