"""Whitening against numpy's eigenvectors and Python's whole numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, n int, x string"


def test_jacobi_keeps_small_lengths_accurate():
    rng = np.random.default_rng(1)
    a = np.linalg.qr(rng.normal(size=(40, 31)), mode="r") * 10.0 ** -np.linspace(0, 12, 31)
    axes, lengths = whitening.jacobi(a)
    assert np.abs(axes.T @ axes - np.eye(31)).max() < 1e-13
    assert np.allclose(np.linalg.norm(a @ axes, axis=0), lengths, rtol=1e-12, atol=0)
    assert (np.diff(lengths) <= 0).all() and abs(np.prod(lengths) / abs(np.linalg.det(a)) - 1) < 1e-9


def test_query_equals_eigenvectors(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in r.embedding] for r in rows])
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1][:32], v[:, ::-1][:, :32]
    want = centred @ v / np.sqrt(e)
    got = queries.op11_whitening(spark, sf_dir).collect()
    place = {r.vec_id: i for i, r in enumerate(rows)}
    assert len(got) == 32 * n and {r.n for r in got} == {n}
    out = np.zeros((n, 32))
    for r in got:
        i = place[r.vec_id]
        out[i, r.component - 1] = r.whitened
        assert r.deviation == sum((n * c - s) ** 2 for c, s in zip(x[i].tolist(), sums.tolist(), strict=True))
        assert abs(r.explained / (e[r.component - 1] * n / (centred**2).sum()) - 1) < 1e-10
    signs = np.sign((out * want).sum(axis=0))
    assert np.abs(out * signs - want).max() < 1e-8
    away = out - out.mean(axis=0)
    assert np.abs(away.T @ away / n - np.eye(32)).max() < 1e-10 and got[0].identity_error < 1e-10


@pytest.mark.parametrize("partitions", [1, 150])
def test_factors_meet_in_levels(spark, partitions):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 5)) * [4, 2, 1, 0.5, 0.1]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>").repartition(partitions, "vec_id")
    x = whitening.fixed_point(df, 1 << 20, 0, "vec_id", "embedding")
    got = whitening.fit(x, 5)
    fixed = np.floor(v * (1 << 20))
    e = np.linalg.eigvalsh(np.cov(fixed.T, bias=True))[::-1]
    assert np.allclose(got.deviations**2, e, rtol=1e-10) and got.n == 300


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], 7, "a"), (1, [1.0, 2.0], 7, "a"), (None, [3.0, 1.0], None, None), (2, None, 1, "b"), (3, [1.0, None], 1, "b"), (4, [nan, 1.0], 1, "b"), (5, [inf, 1.0], 1, "b"), (6, [], 1, "b"), (7, [1.0, 2.0, 3.0], 1, "b")]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.vec_id or 0, r.n, len(r.whitened)) for r in got) == [(0, 3, 1), (1, 3, 1), (1, 3, 1)]  # one direction varies
    assert whitening.whiten(spark.createDataFrame(rows[:0], SCHEMA)).count() == 0
    alike = whitening.whiten(spark.createDataFrame(rows[:2], SCHEMA)).collect()
    assert [r.whitened for r in alike] == [[], []] and [int(r.deviation) for r in alike] == [0, 0]


def test_deviations_past_64_bits(spark):
    rows = [(i, [float(i * 1e6), 1.0], 0, "") for i in range(40)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA), scale=1000).orderBy("vec_id").collect()
    x = [i * 10**9 for i in range(40)]
    assert [int(r.deviation) for r in got] == [(40 * c - sum(x)) ** 2 for c in x] and int(got[0].deviation) > 2**63


def test_table_of_one_column_name_each(spark):
    df = spark.createDataFrame([(i, [float(i), float(i * i)]) for i in range(9)], "id int, x array<double>").withColumn("i", F.lit(1))
    got = whitening.whiten(df, 2, id_col="id", vector_col="x")
    assert got.columns[0] == "id" and got.count() == 9
