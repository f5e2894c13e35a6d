"""Shards of near-equal bytes by histogram sort.

Keys are 64-bit: forty bits of a hash of the text, then twenty-four of a hash of the id. So equal texts are neighbours, and a
group of copies can still be cut where one shard can't hold it. Splitters are found by counting: each round sums exact bytes
and rows between probes, which divide the key intervals that hold a splitter, over all partitions. Only rows of intervals in
which a splitter isn't yet near enough its target are counted again, between finer probes. Then rows are exchanged once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import checkpointed

#: The low bits of a key, which hold the id's hash; keys that differ only there have equal texts.
ID_BITS = 24
TEXT_BITS = 64 - ID_BITS
#: Probes of a round, as a power of two: at first, and as many as the driver may hold.
FIRST, MOST = 14, 22
#: Rows that a task counts at least, and intervals up to which they are named in the plan instead of joined.
COUNTED, NAMED = 1_000_000, 1000
#: Work units within a shard may miss their number of rows by this part.
SLACK = 0.25


def sort_key(text: Column, ident: Column) -> Column:
    """Rows without an id have no hash of it; their places in the table part them."""
    low = (1 << ID_BITS) - 1
    unnamed = F.when(ident.isNull(), F.monotonically_increasing_id())
    return F.xxhash64(text).bitwiseAND(F.lit(~low)).bitwiseOR(F.xxhash64(ident, unnamed).bitwiseAND(F.lit(low)))


@dataclass
class Cells:
    """Intervals of keys in order: where each begins, the bits that its keys share, its bytes and rows."""

    start: np.ndarray
    bits: np.ndarray
    size: np.ndarray
    rows: np.ndarray

    def below(self, of: np.ndarray) -> np.ndarray:
        """Sums of ``of`` before each cell, and of all."""
        return np.concatenate(([0], np.cumsum(of)))

    def replaced(self, gone: np.ndarray, new: Cells) -> Cells:
        """Without the cells ``gone`` and with those of ``new``."""
        both = [np.concatenate((mine[~gone], theirs)) for mine, theirs in ((self.start, new.start), (self.bits, new.bits), (self.size, new.size), (self.rows, new.rows))]
        order = np.argsort(both[0], kind="stable")
        return Cells(*(x[order] for x in both))


def count_between(keyed: DataFrame, bits: int, inside: np.ndarray | None = None, inside_bits: int = 0) -> Cells:
    """Exact bytes and rows of (key, size) between probes ``2 ** (64 - bits)`` apart, of the keys alone whose first
    ``inside_bits`` bits are in ``inside``. One job; what comes back is a row for each interval that holds keys."""
    first = lambda n: F.shiftright("key", 64 - n)
    if inside is not None and len(inside) <= NAMED:
        keyed = keyed.where(first(inside_bits).isin(inside.tolist()))
    elif inside is not None:  # at most 2 ** MOST numbers
        known = keyed.sparkSession.createDataFrame([(x,) for x in inside.tolist()], "first long")
        keyed = keyed.join(F.broadcast(known), first(inside_bits) == F.col("first"), "left_semi")
    got = keyed.groupBy(first(bits).alias("cell")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).toArrow()
    cell, size, rows = (got.column(c).to_numpy().astype(np.int64) for c in ("cell", "bytes", "rows"))
    order = np.argsort(cell)
    return Cells(cell[order] << (64 - bits), np.full(len(cell), bits), size[order], rows[order])


def _far(below: np.ndarray, targets: np.ndarray, allowed: float) -> np.ndarray:
    """Cells in which a target lies further than ``allowed`` from both ends."""
    at = np.clip(np.searchsorted(below, targets, side="left"), 1, len(below) - 1)
    far = np.minimum(targets - below[at - 1], below[at] - targets) > allowed
    return np.unique(at[far] - 1)


def _nearest(below: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """The edge between cells that is nearest each target; the earlier of two."""
    at = np.clip(np.searchsorted(below, targets, side="left"), 1, len(below) - 1)
    return np.where(targets - below[at - 1] <= below[at] - targets, at - 1, at)


def find_splitters(keyed: DataFrame, rows: int, total: int, shards: int, tolerance: float, rows_per_part: int) -> tuple[Cells, np.ndarray, np.ndarray]:
    """Cells, and the edges between them at which shards and at which parts of shards begin, of (key, size) rows.

    Shard edges divide the bytes evenly, within ``tolerance`` of a shard; parts divide the rows by ``rows_per_part``. Probes go to
    edges between texts first, and inside a group of copies only where those aren't near enough. A cell of one row, or of one
    key, is not divided. With b the bits of the first round there are at most 2 + (64 - b) / s rounds of s bits each, where 2 ** s
    is the number of probes for each open cell: five, while no more than eight cells are open."""
    by_bytes = np.arange(1, shards) * total / shards
    by_rows = np.arange(1, -(-rows // rows_per_part)) * float(rows_per_part)
    parts = len(by_rows) + shards
    level = min(max((8 * parts - 1).bit_length(), FIRST), MOST)
    budget = max(level, FIRST + 2)
    cells = count_between(keyed, level)
    while True:
        open_ = np.union1d(_far(cells.below(cells.size), by_bytes, tolerance * total / shards), _far(cells.below(cells.rows), by_rows, SLACK * rows_per_part))
        open_ = open_[(cells.bits[open_] == level) & (cells.rows[open_] > 1)]
        if not len(open_) or level == 64:
            break
        finer = min(level + max(1, budget - (len(open_) - 1).bit_length()), TEXT_BITS if level < TEXT_BITS else 64)
        gone = np.zeros(len(cells.start), bool)
        gone[open_] = True
        cells = cells.replaced(gone, count_between(keyed, finer, cells.start[open_] >> (64 - level), level))
        level = finer
    return cells, _nearest(cells.below(cells.size), by_bytes), _nearest(cells.below(cells.rows), by_rows)


def shard_by_bytes(docs: DataFrame, shards: int = 8, tolerance: float = 0.001, rows_per_part: int = 100_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``.

    Size is the text's UTF-8 bytes plus 1. Shards hold near-equal bytes; copies of a text share a shard unless that would
    move its edge by more than ``tolerance`` of a shard. Slots count from 0 in each shard, in key order. A shard is several
    range parts of about ``rows_per_part`` rows, however small those are, each sorted and numbered in its own task.

    Edge cases: a null text has size 1 and the CRC of no bytes; rows with a null id are told apart by their places; rows with
    equal ids and texts stay together, in any order; with fewer rows than shards some shards are empty; an empty table gives no
    rows. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = checkpointed(docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), sort_key(text, F.col(id_col)).alias("key")))
    rows, total = keyed.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    splitters, shard_of, base = np.empty(0, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
    if rows:
        # Small partitions are counted together, so that a round has no more tasks than it has work.
        counted = keyed.select("key", "size").coalesce(-(-rows // COUNTED))
        cells, shard_edges, part_edges = find_splitters(counted, rows, total, shards, tolerance, rows_per_part)
        starts = np.union1d([0], np.concatenate((shard_edges, part_edges)))
        starts = starts[starts < len(cells.start)].astype(np.int64)  # what would begin after the last row is empty
        splitters, before = cells.start[starts[1:]], cells.below(cells.rows)[starts]
        shard_of = np.searchsorted(shard_edges, starts, side="right")
        base = before - before[np.searchsorted(shard_of, shard_of, side="left")]

    # An edge that is passed is one part further on; of many edges, half are left out at each step of a search.
    steps = len(splitters).bit_length()
    edges = F.lit(splitters)
    found = F.reduce(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0).alias("low"), F.lit(len(splitters)).alias("high")), lambda s, _: _halve(s, edges, F.col("key")), lambda s: s["low"]) if len(splitters) > 64 else sum((F.when(F.col("key") >= s, 1).otherwise(0) for s in splitters.tolist()), F.lit(0))
    part = keyed.withColumn("part", found.cast("int")).repartitionById(len(base), "part")
    number = F.row_number().over(Window.partitionBy("part").orderBy("key", "id")) - 1
    at = lambda values: F.element_at(F.lit(values.astype(np.int64)), F.col("part") + 1)
    return part.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), at(shard_of).cast("int").alias("shard"),
        (at(base) + number).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def _halve(state: Column, edges: Column, key: Column) -> Column:
    """One step of a search for the number of edges that are at most ``key``."""
    low, high = state["low"], state["high"]
    middle = F.floor((low + high) / 2).cast("int")
    right = (low < high) & (F.get(edges, middle) <= key)
    return F.struct(F.when(right, middle + 1).otherwise(low).alias("low"), F.when((low < high) & ~right, middle).otherwise(high).alias("high"))
