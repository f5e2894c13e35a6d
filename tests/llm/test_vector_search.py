import inspect

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.llm import vector_search
from quillspark.llm.vector_search import brute_force, exact_top_k


@pytest.mark.parametrize("integral", [True, False])
def test_equals_brute_force(spark, integral):
    rng = np.random.default_rng(3)
    v = rng.integers(-60, 60, (400, 16)).astype(float) if integral else rng.normal(size=(400, 16))
    v[100:140] = v[7]  # ties and copies
    vectors = {i: x for i, x in enumerate(v)}
    df = spark.createDataFrame([(i, x.tolist(), "clash") for i, x in vectors.items()], "vec_id long, embedding array<double>, vector string")
    got = exact_top_k(df, F.col("vec_id") % 20 == 0, k=10, integral=integral, query_block=8, row_block=64).collect()
    want = {(q, r): (i, s) for q, r, i, s in brute_force(vectors, list(range(0, 400, 20)), 10)}
    assert len(got) == len(want) == 200
    for r in got:
        i, s = want[(r.query_id, r["rank"])]
        assert abs(r.score - s) < 1e-9 and (not integral or r.vec_id == i)


def test_edge_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, []), (6, [3.0, 1.0]), (None, [1.0, 1.0]), (6, [3.0, 1.0]), (7, [1.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in exact_top_k(df, F.col("vec_id") == 0).collect()]
    assert got == [(0, 1, 6, 5.0), (0, 2, 6, 5.0)]  # both rows of that id
    assert exact_top_k(df.limit(0), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("bits", [2, 6])
def test_a_third_of_all_vectors_alike(spark, bits):
    rng = np.random.default_rng(8)
    v = rng.integers(-30, 31, (600, 12)).astype(float)
    v[::3] = v[0]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = exact_top_k(df, F.col("vec_id") % 20 == 0, k=5, bits=bits, integral=True, query_block=16, row_block=100).collect()
    want = set(brute_force(dict(enumerate(v)), list(range(0, 600, 20)), 5))
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want


def test_cells_are_wider_than_a_component():
    default = inspect.signature(exact_top_k).parameters["bits"].default
    for low, high in ((-32.0, 34.0), (-30.0, 30.0), (0.0, 1.0)):
        width, half = vector_search.cells(low, high, default, True)
        assert width >= 2 and half == (width - 1) / 2 and (high - low) / width < 2**default


def test_bounds_leave_few_to_read():
    rng = np.random.default_rng(9)
    x = np.floor(64 * rng.normal(size=(2000, 64)) / 8)
    low = x.min()
    width, half = vector_search.cells(low, x.max(), inspect.signature(exact_top_k).parameters["bits"].default, True)  # as the query has them
    block = pd.DataFrame({"row": range(2000), "id": range(2000), "alike": range(2000), "cells": list(np.floor((x - low) / width))})
    queries = pd.DataFrame({"row": range(0, 2000, 20), "vector": list(x[::20])})
    open_ = vector_search._candidates(queries, block, 20, low, width, half)
    scores = x[::20] @ x.T
    scores[np.arange(100), np.arange(0, 2000, 20)] = -np.inf
    left = set(zip(open_["q"], open_["row"], strict=True))
    for i in range(100):
        assert all((20 * i, int(j)) in left for j in np.argsort(-scores[i], kind="stable")[:20])
    assert len(left) < 0.1 * 100 * 2000
    assert (np.abs(open_["near"] - scores[open_["q"] // 20, open_["row"]]) <= open_["reach"] / 2).all()
