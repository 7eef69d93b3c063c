"""Registered raster queries against their SQL in DuckDB, on the same tables."""

import duckdb
import numpy as np
import pytest

from tessera.plans import sql
from tessera.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
SLOW = {"gaussian_pyramid_4", "gaussian_pyramid_8", "scale_space", "dog_plane", "stereo_disparity", "key_counts"}  # covered by the other queries of their operators


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in ("embeddings", "events", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(SQL) - SLOW))
def test_query(spark, tables, name):
    mine, theirs = QUERIES[name](spark, SF).toPandas(), tables.execute(SQL[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    mine, theirs = (x[columns].sort_values(columns).reset_index(drop=True) for x in (mine, theirs))
    assert len(mine) == len(theirs)
    for c in columns:
        same = (mine[c] == theirs[c]) | (mine[c].isna() & theirs[c].isna())
        assert same.all(), (c, mine[~same].head(), theirs[~same].head())


def ties(spark, path):
    """A table of vectors with components that lie in the middle of two numbers of six decimals."""
    rows = [(i, [(64 * i + k - 500) / 128 for k in range(64)], 0) for i in range(16)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet/*.parquet'")
    return con


def test_key_lines_of_ties(spark, tmp_path):
    con = ties(spark, tmp_path)
    assert sorted(map(tuple, QUERIES["keyfile_lines"](spark, str(tmp_path)).collect())) == sorted(con.execute(SQL["keyfile_lines"]).fetchall())


def test_key_round_trip_of_ties(spark, tmp_path):
    con = ties(spark, tmp_path)
    columns = "idx", "idy", "oct", "step", "angle", "scale", "millionths"
    mine = QUERIES["keyfile_roundtrip"](spark, str(tmp_path)).select(*columns)
    assert sorted(map(tuple, mine.collect())) == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({SQL['keyfile_roundtrip']})").fetchall())


@pytest.mark.parametrize("name, text", [("kd_build", sql.kd_build), ("kd_leaf_of_query", sql.kd_leaf), ("kd_bbf_search", sql.kd_search)])
def test_tree_of_more_keys_than_the_sql_splits(spark, tmp_path, name, text):
    """The registered SQL splits 12 levels, enough for 4,096 keys; the tree of more is that of the same SQL with more levels."""
    data = np.random.default_rng(9).normal(0, 0.1, (4200, 64))
    spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(data)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    mine = QUERIES[name](spark, str(tmp_path))
    rows = sorted(map(tuple, mine.collect()))
    assert rows == sorted(con.execute(f"SELECT {', '.join(mine.columns)} FROM ({text(13)})").fetchall())
    if name == "kd_bbf_search":
        assert rows == [(i, i, 0.0) for i in range(0, 4200, 20)]  # each query is a key; 12 levels leave 104 of the keys out
