import pathlib

import duckdb
import pandas as pd
import pytest

from riskspark.llm import queries


def values(frame):
    frame = frame[sorted(frame.columns)].astype(object).where(lambda x: x.notna(), None)
    return sorted(tuple(str(v) for v in row) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for path in pathlib.Path(sf).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    want = con.execute(queries.SQL[name]).df()
    got = pd.DataFrame([r.asDict() for r in queries.QUERIES[name](spark, sf).collect()])
    assert sorted(got.columns) == sorted(want.columns)
    assert values(got) == values(want)
