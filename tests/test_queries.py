"""Each query against its SQL on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd
import pytest

from cuelight import queries
from cuelight.operators import search


def value(v):
    """Missing values as None, whole numbers as ints (nulls make pandas hold them as floats), others to six places."""
    if pd.isna(v):
        return None
    if isinstance(v, float):
        return int(v) if v.is_integer() else round(v, 6)
    return v


def plain(frame):
    frame = frame[sorted(frame.columns)]
    rows = [tuple(map(value, r)) for r in frame.itertuples(index=False)]
    return list(frame.columns), sorted(rows, key=repr)


def run_sql(data, sql):
    con = duckdb.connect()
    for file in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    return con.execute(sql).df()


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, data, name):
    assert plain(queries.QUERIES[name](spark, data).toPandas()) == plain(run_sql(data, queries.SQL[name]))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 40
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_whole_questions(spark, data):
    """Whole texts of questions are searched, by the entry too."""
    import __spark_entry__

    assert sorted(r.query for r in queries.questions(spark, data).collect()) == sorted(r.text for r in queries.table(spark, data, "benchmark").collect())
    assert not any("substr(text, 1, 80)" in sql or "substr(text, 1, 60)" in sql for sql in queries.SQL.values())
    assert plain(__spark_entry__.entry(spark).toPandas()) == plain(run_sql(data, queries.SQL["eval_per_query"]))


def test_joined_terms_give_the_same_scores(spark, data, monkeypatch):
    """The way for more terms than may be sent to every task."""
    small = plain(queries.search_topk(spark, data).toPandas())
    monkeypatch.setattr(search, "_BROADCAST_BYTES", 0)
    assert plain(queries.search_topk(spark, data).toPandas()) == small
