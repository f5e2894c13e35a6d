"""Exact top-k inner-product search with vector-approximation files.

Every vector gets a coarse copy: one small integer cell per component, all of one width. A block of queries scans a block of
cells by one product with the cells' middles, which bounds each score from above and below by the same reach. What no block can
rule out meets at its query, where the k-th lower bound over all blocks rules out more. Only then are exact vectors read, each
block's in order of their upper bounds, until no unread one can be among the k; the blocks' exact lists are merged per query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import written

#: Exact vectors that are read at a time, at first, and queries whose bounds are in memory together.
FIRST_READ, AT_A_TIME = 64, 256


def _valid(vector: Column) -> Column:
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def cells(low: float, high: float, bits: int, integral: bool) -> tuple[float, float]:
    """Width of a cell for components from ``low`` to ``high``, and how far its middle is from its ends.

    A cell of whole numbers has so many of them, whose middle is half of one less away from the first. It has two at least: cells of
    one number each would be the vectors themselves, and scanning them a search without an index."""
    if integral:
        width = float(max(2, math.ceil((high - low + 1) / 2**bits)))
        return width, (width - 1) / 2
    width = (high - low) / 2**bits or 1.0
    return width, width / 2


def _candidates(queries: pd.DataFrame, block: pd.DataFrame, k: int, low: float, width: float, half: float) -> pd.DataFrame:
    """(q, row, near, reach) that the block's own bounds can't rule out; scores lie within half of ``reach`` of ``near``."""
    block = block.sort_values(["id", "row"], kind="stable")
    # Of equal vectors those with the smallest ids come first: k of them, and one that may be the query itself.
    block = block[block.groupby(["alike"]).cumcount() <= k]
    middle = (low + np.stack(block["cells"].to_numpy()).astype(np.float64) * width + half).astype(np.float32)
    rows, most, out = block["row"].to_numpy(np.int64), float(np.abs(middle).max()), []
    for at in range(0, len(queries), AT_A_TIME):
        some = queries.iloc[at : at + AT_A_TIME]
        q, q_rows = np.stack(some["vector"].to_numpy()), some["row"].to_numpy(np.int64)
        size = np.abs(q).sum(axis=1)
        # Half a cell in each component, and what products in single precision can be off by.
        reach = 2 * size * (half + q.shape[1] * 2.0**-22 * (most + half) + 1e-12)
        near = q.astype(np.float32) @ middle.T
        near[q_rows[:, None] == rows[None, :]] = -np.inf
        sure = np.partition(near, len(rows) - k, axis=1)[:, len(rows) - k] if len(rows) > k else np.full(len(q), -np.inf)
        i, j = np.nonzero((near >= (sure - reach)[:, None]) & (near > -np.inf))
        out.append(pd.DataFrame({"q": q_rows[i], "row": rows[j], "near": near[i, j].astype(np.float64), "reach": reach[i]}))
    return pd.concat(out, ignore_index=True)


def _read(asks: pd.DataFrame, block: pd.DataFrame, k: int) -> pd.DataFrame:
    """(q, query_id, row, id, score): the exact top k of each query among its candidates, read from the highest bound on."""
    block = block.sort_values("row")
    rows, ids, x = block["row"].to_numpy(np.int64), block["id"].to_numpy(np.int64), np.stack(block["vector"].to_numpy())
    out = []
    for ask in asks.itertuples(index=False):
        near, wanted = np.array(ask.near), np.searchsorted(rows, np.array(ask.rows, np.int64))
        best, found, at, step = np.empty(0), np.empty(0, np.int64), 0, max(k, FIRST_READ)
        while at < len(wanted) and not (len(best) == k and best[-1] > near[at] + ask.reach / 2):
            read = wanted[at : at + step]
            found, best = np.concatenate((found, read)), np.concatenate((best, x[read] @ ask.vector))
            keep = np.lexsort((rows[found], ids[found], -best))[:k]
            found, best, at, step = found[keep], best[keep], at + step, step * 2
        out.append(pd.DataFrame({"q": ask.q, "query_id": ask.query_id, "row": rows[found], "id": ids[found], "score": best}))
    return pd.concat(out, ignore_index=True)


def exact_top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    bits: int = 6, integral: bool = False, query_block: int = 4096, row_block: int = 4096,
) -> DataFrame:
    """The ``k`` largest inner products of each query row with all other rows: query_id, rank (from 1), ``id_col``, score.

    ``is_query`` is a condition on ``vectors``; ``bits`` is the size of a cell (at most 7); ``integral`` says that components
    are whole numbers, which makes bounds tighter. Cells go out once for each block of queries, queries once for each block of
    rows, exact vectors once.

    Edge cases: vectors that are null, empty, or hold null or non-finite components, and rows with a null id, take no part.
    Rows count as rows: those that share an id or a vector are candidates each, and a query's own row alone is left out.
    Vectors of another length are never compared. Fewer than ``k`` candidates give them all; equal scores go to the smaller id.
    An empty table gives no rows. Other columns are ignored. Vectors are taken as equal by a 64-bit hash with their cells.
    """
    vector = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = written(rows.where(F.col("id").isNotNull() & _valid(F.col("vector"))).withColumn("row", F.monotonically_increasing_id()))
    low, high, n, asked = rows.agg(F.min(F.array_min("vector")), F.max(F.array_max("vector")), F.count("*"), F.count_if("asks")).first()
    low, high = (0.0, 0.0) if low is None else (low, high)
    width, half = cells(low, high, bits, integral)
    row_blocks, query_blocks = max(1, math.ceil(n / row_block)), max(1, math.ceil(asked / query_block))
    cell = lambda x: F.least(F.floor((x - F.lit(low)) / F.lit(width)), F.lit(2**bits - 1)).cast("tinyint")
    deal = lambda blocks: F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("row_block")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dim, key = F.size("vector").alias("dim"), ["dim", "row_block", "query_block"]
    scanned = rows.select("row", "id", F.transform("vector", cell).alias("cells"), F.xxhash64("vector", F.transform("vector", cell)).alias("alike"), dim, deal(row_blocks), every(query_blocks).alias("query_block"))
    queries = rows.where("asks").select(F.col("row").alias("q"), F.col("id").alias("query_id"), "vector", dim)
    asking = queries.select(F.col("q").alias("row"), "vector", "dim", F.pmod(F.xxhash64("q", F.lit(2)), F.lit(query_blocks)).cast("int").alias("query_block"), every(row_blocks).alias("row_block"))

    def scan(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or block.empty:
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "row": pd.Series(dtype="int64"), "near": pd.Series(dtype="float64"), "reach": pd.Series(dtype="float64")})
        return _candidates(queries, block, k, low, width, half)

    def read(asks: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if asks.empty or block.empty:
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("q", "query_id", "row", "id")} | {"score": pd.Series(dtype="float64")})
        return _read(asks, block, k)

    found = asking.groupBy(*key).cogroup(scanned.groupBy(*key)).applyInPandas(scan, "q long, row long, near double, reach double")
    of = Window.partitionBy("q")
    placed = found.withColumn("place", F.row_number().over(of.orderBy(F.desc("near"), "row")))
    sure = F.max(F.when(F.col("place") == k, F.col("near"))).over(of)
    open_ = placed.withColumn("sure", sure).where(F.col("sure").isNull() | (F.col("near") >= F.col("sure") - F.col("reach")))
    listed = open_.groupBy("q", deal(row_blocks)).agg(F.max("reach").alias("reach"), F.sort_array(F.collect_list(F.struct("near", "row")), asc=False).alias("open"))
    asks = listed.join(queries, "q").select("q", "query_id", "vector", "dim", "row_block", "reach", F.col("open.near").alias("near"), F.col("open.row").alias("rows"))
    exact = asks.groupBy("dim", "row_block").cogroup(rows.select("row", "id", "vector", dim, deal(row_blocks)).groupBy("dim", "row_block")).applyInPandas(read, "q long, query_id long, row long, id long, score double")
    order = of.orderBy(F.desc("score"), "id", "row")
    return exact.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def brute_force(vectors: dict[int, np.ndarray], queries: list[int], k: int) -> Iterator[tuple[int, int, int, float]]:
    """What ``exact_top_k`` must give, for tests."""
    for q in queries:
        scores = sorted((-float(np.dot(vectors[q], v)), i) for i, v in vectors.items() if i != q)
        for rank, (score, i) in enumerate(scores[:k], 1):
            yield q, rank, i, -score
