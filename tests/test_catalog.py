"""Registered queries against their SQL, on the small tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracles import rows_of
from threadlab.catalog.queries import QUERIES

CHECKED = [name for name in queries() if name in oracle_sql()]


@pytest.fixture(scope="module")
def con(sf):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, sf, con, name):
    df = queries()[name](spark, sf)
    cursor = con.execute(oracle_sql()[name])
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
    assert set(QUERIES) - set(oracle_sql()) == {
        "text_features", "train_history", "topic_workflow", "cv_fold_metrics", "zero_shot_trained_pairs",
    }


def test_entry(spark):
    assert entry(spark).count() > 0
