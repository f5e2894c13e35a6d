"""An index for searches by many vectors: rows stored by the nearest of some centroids, of which a query reads a few.

Centroids are fitted on a bounded sample; every row is stored, in a partition for each centroid. A query's probes become a filter on
partitions, so that cells that no query probes aren't read. How many cells a query probes is chosen by the recall that is measured on
the sample. ``search_many`` stays the exact way.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators.search import _nearest

#: Rows of the sample at most, rounds of k-means, and queries of the sample by which probes are chosen.
SAMPLE, ROUNDS, TRIED = 50_000, 12, 500
CELL = "cell"


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def centroids(x: np.ndarray, cells: int, seed: int = 1) -> np.ndarray:
    """Unit centroids of unit vectors by spherical k-means; one without vectors becomes the vector that is farthest from its own."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(ROUNDS):
        near = x @ c.T
        at = near.argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        empty = np.flatnonzero(np.bincount(at, minlength=len(c)) == 0)
        sums[empty] = x[np.argsort(near.max(axis=1), kind="stable")[: len(empty)]]
        c = unit(sums)
    return c


def recall_by_probes(x: np.ndarray, c: np.ndarray, k: int, tried: int = TRIED) -> np.ndarray:
    """Of the ``k`` nearest of some vectors of ``x``, the part in the first 1, 2, ... cells."""
    q = x[:: max(1, len(x) // tried)]
    cell, order = (x @ c.T).argmax(axis=1), np.argsort(-(q @ c.T), axis=1, kind="stable")
    k = min(k, len(x))
    near = np.argpartition(-(q @ x.T), k - 1, axis=1)[:, :k]
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(c))[None, :], axis=1)
    found = np.take_along_axis(place, cell[near], axis=1)
    return np.cumsum(np.bincount(found.ravel(), minlength=len(c))) / found.size


@dataclass(frozen=True)
class VectorIndex:
    """An index that was built: where its rows are, its centroids, and cells that a query probes."""

    path: str
    cells: np.ndarray
    probes: int
    recall: float

    @property
    def dim(self) -> int:
        return self.cells.shape[1]

    kind: str = "id long, embedding array<double>"

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"{self.kind}, {CELL} int").parquet(f"{self.path}/rows")


def _ranked(cells: np.ndarray, n: int, column: str):
    """The ``n`` nearest cells of each row's vector."""

    def over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if f.empty:
                continue
            near = unit(np.stack(f[column].to_numpy()).astype(float)) @ cells.T
            first = np.argsort(-near, axis=1, kind="stable")[:, :n]
            yield f.iloc[np.repeat(np.arange(len(f)), first.shape[1])].assign(**{CELL: first.ravel().astype("int32")})

    return over


def build(collection: DataFrame, path: str, cells: int = 64, k: int = 10, recall: float = 0.95, id_col: str = "id", sample: int = SAMPLE) -> VectorIndex:
    """Stores ``id_col`` and embedding of all rows of the commonest dimension below ``path``, by cell, and what queries need.

    ``sample`` rows (by a hash, so that all kinds of rows have a chance) are what centroids and probes are fitted on: about as many
    come to the driver, twice that at most. ``recall`` is the part of the k nearest that probes must find there. Rows of another
    dimension, or without a vector, are left to ``search_many``; an empty collection has one cell and no rows."""
    spark, rows = collection.sparkSession, collection.where(F.size("embedding") > 0).select(id_col, "embedding")
    common = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim, n = (common["dim"], common["count"]) if common else (1, 0)
    rows = rows.where(F.size("embedding") == dim)
    part = min(1.0, sample / max(n, 1))
    taken = rows.where(F.pmod(F.xxhash64(id_col, F.lit(7)), F.lit(1 << 30)) < int(part * (1 << 30))).select("embedding").limit(2 * sample).collect()
    x = unit(np.array([r["embedding"] for r in taken], float)) if taken else np.ones((1, dim))
    c = centroids(x, cells)
    by_probes = recall_by_probes(x, c, k)
    probes = int(np.searchsorted(by_probes, recall - 1e-12)) + 1
    kind = rows._jdf.schema().toDDL()
    assigned = rows.mapInPandas(_ranked(c, 1, "embedding"), f"{kind}, {CELL} int")
    # A large cell is dealt over several tasks, and so has several files.
    assigned.repartition(CELL, F.pmod(F.xxhash64(id_col), F.lit(4))).write.mode("overwrite").partitionBy(CELL).parquet(f"{path}/rows")
    about = {"cells": c.tolist(), "probes": min(probes, len(c)), "recall": float(by_probes[min(probes, len(c)) - 1]), "kind": kind}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
    return VectorIndex(path, c, about["probes"], about["recall"], about["kind"])


def load(spark: SparkSession, path: str) -> VectorIndex:
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    return VectorIndex(path, np.array(about["cells"]), about["probes"], about["recall"], about["kind"])


def search_index(index: VectorIndex, queries: DataFrame, k: int = 10, probes: int | None = None, id_col: str = "id", query_id: str = "query_id", block: int = 2000, row_block: int = 8192) -> DataFrame:
    """query_id, rank, ``id_col``, score of the ``k`` nearest among the cells that each query probes; all cells make it exact.

    Queries of another dimension have no result. A query meets the blocks of the cells that it probes, so a cell that many queries
    probe, or that has many rows, is as many tasks."""
    spark, n = queries.sparkSession, probes or index.probes
    asked = queries.where(F.size("embedding") == index.dim).select(F.col(query_id).alias("q"), "embedding")
    probing = asked.mapInPandas(_ranked(index.cells, n, "embedding"), f"{asked._jdf.schema().toDDL()}, {CELL} int")
    stored = index.rows(spark)
    wanted = sorted(r[0] for r in probing.select(CELL).distinct().collect())  # cells at most
    stored = stored.where(F.col(CELL).isin(wanted))
    counts = {side: {r[0]: -(-r[1] // size) for r in frame.groupBy(CELL).count().collect()} for side, frame, size in (("row", stored, row_block), ("query", probing, block))}
    blocks = lambda side: F.create_map(*[F.lit(v) for c in wanted or [-1] for v in (c, counts[side].get(c, 1))])[F.col(CELL)]
    deal = lambda key, side: F.pmod(F.xxhash64(*key), blocks(side)).cast("int").alias(f"{side}_block")
    every = lambda side: F.explode(F.sequence(F.lit(0), blocks(side) - 1)).alias(f"{side}_block")
    asking = probing.select("q", "embedding", CELL, deal(["q", "embedding"], "query"), every("row"))
    rows = stored.select(F.col(id_col).alias("i"), "embedding", CELL, deal([id_col, "embedding"], "row"), every("query"))
    kinds = dict(stored.dtypes)[id_col], dict(queries.dtypes)[query_id]
    found = _nearest(asking, rows, [CELL, "row_block", "query_block"], k, *kinds)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "i"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias(query_id), "rank", F.col("i").alias(id_col), F.col("s").alias("score"))
