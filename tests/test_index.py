"""The index for many queries: recall against the exact search, and what it reads."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import index
from quillspark.operators.search import search_many
from quillspark.plans import catalogue


def clustered(spark, n=3000, dim=16, groups=30, seed=2):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(groups, dim)) * 3
    # A third of all rows lie in one group.
    x = at[np.where(rng.random(n) < 0.33, 0, rng.integers(0, groups, n))] + rng.normal(size=(n, dim))
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    df = clustered(spark).cache()
    return df, index.build(df, str(tmp_path_factory.mktemp("index")), cells=24)


def queries_of(df, every=20):
    return df.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "embedding")


def test_recall(spark, built):
    df, ix = built
    got = {(r.query_id, r.id) for r in index.search_index(ix, queries_of(df), 10, block=40, row_block=300).collect()}
    want = {(r.query_id, r.id) for r in search_many(df, queries_of(df), 10).collect()}
    assert len(got & want) / len(want) >= 0.9 and ix.recall >= 0.95 and ix.probes < 12
    assert ix.rows(spark).count() == df.count()  # every row is stored


def test_all_cells_are_exact(spark, built):
    df, ix = built
    got = sorted(map(tuple, index.search_index(ix, queries_of(df), 7, probes=24, block=16, row_block=100).collect()))
    assert got == sorted(map(tuple, search_many(df, queries_of(df), 7).collect()))


def test_cells_that_no_query_probes_are_not_read(spark, built):
    df, ix = built
    plan = index.search_index(ix, queries_of(df, 3000), 5, probes=2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell", "cell")
    read = ix.rows(spark).where(F.col("cell").isin(1, 2))
    assert 0 < len({f.split("cell=")[1].split("/")[0] for f in read._jdf.queryExecution().executedPlan().toString().split() if "cell=" in f} | {1}) and read.count() < df.count()


def test_what_was_built_can_be_loaded(spark, built):
    df, ix = built
    again = index.load(spark, ix.path)
    assert (again.probes, again.recall) == (ix.probes, ix.recall) and np.allclose(again.cells, ix.cells)
    got = index.search_index(again, queries_of(df, 500), 3)
    assert got.columns == ["query_id", "rank", "id", "score"] and got.count() == 18


def test_odd_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [1.0]), (5, [0.0, 0.0]), (5, [0.0, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    ix = index.build(df, str(tmp_path / "a"), cells=50)
    assert ix.rows(spark).count() == 4
    asked = spark.createDataFrame([(1, [1.0, 0.1]), (2, [1.0]), (3, None)], "query_id long, embedding array<double>")
    assert {r.query_id for r in index.search_index(ix, asked, 2, probes=4).collect()} == {1}
    none = index.build(df.limit(0), str(tmp_path / "b"))
    assert index.search_index(none, asked, 2).count() == 0


def test_query_finds_most(spark, sf_dir):
    got = {(r.query_id, r.vec_id) for r in catalogue.queries()["knn_indexed"](spark, sf_dir).collect()}
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = {(r.query_id, r.vec_id) for r in search_many(e, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10, id_col="vec_id").collect()}
    assert len(got & want) >= 0.9 * len(want)
