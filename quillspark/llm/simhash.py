"""SimHash near-duplicates by a hierarchical index in Gray order.

Fingerprints within r bits agree on at least one of r + 1 blocks of bits. So the upper nodes of the index are the patterns
under these block masks, dealt out over the cluster; below each, fingerprints are sorted by Gray rank, in which neighbours
differ in few bits, and runs of eight become nodes that hold the bits their members share. A search pairs nodes from the top
and drops a pair once its shared bits differ in more than r places. A group too large for one task gets a further level of
block masks on the bits in which its members differ. Of the links in a group only a spanning star is passed on; components are
joined by alternating stars on the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import checkpointed, join_stats

FAN_OUT, PAIRS_AT_A_TIME, LARGEST_GROUP, SEED = 8, 1 << 14, 8192, 42
ALL = (1 << 64) - 1


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes; 0 for none."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        counts += votes(hashes[i : i + (1 << 16)])
    return _packed(counts, len(hashes))


def votes(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, the highest first."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return bits.sum(axis=0, dtype=np.int32)


def _packed(counts: np.ndarray, n: int) -> int:
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprint(text: str, words: int = 4) -> int:
    """Bits set in over half of the shingles' hashes; 0 for no words."""
    import xxhash

    tokens = text.encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    n = max(1, len(tokens) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n]
    ends = ends[min(words, len(tokens)) - 1 :]
    hash_ = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):  # a bounded part of a long text at a time
        hashes = np.array([hash_(joined[a:b], SEED) for a, b in zip(starts[i : i + (1 << 16)].tolist(), ends[i : i + (1 << 16)].tolist(), strict=True)], np.uint64)
        counts += votes(hashes)
    return _packed(counts, n)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """id and fp (signed long) of every row."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t or "", words) for t in texts], np.uint64).astype(np.int64))

    return docs.select(F.col(id_col).alias("id"), of(F.col(text_col)).alias("fp"))


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place of each unsigned fingerprint in the Gray sequence."""
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def blocks_of(free: int, n: int) -> list[int]:
    """``n`` masks that share out the free bits."""
    bits = [1 << i for i in range(64) if free >> i & 1]
    return [sum(bits[len(bits) * i // n : len(bits) * (i + 1) // n]) for i in range(n)]


class Stars:
    """Union of links between places, each component under its smallest place."""

    def __init__(self, n: int):
        self.top = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            a, b = self.top[a], self.top[b]
            apart = a != b
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.top, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := self.top[self.top], self.top):
                self.top = up


def links(fp: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs in the same group that differ in at most ``radius`` bits; rows come sorted by group and Gray rank."""
    levels = [(np.full(len(fp), ALL, np.uint64), fp, group, np.arange(len(fp) + 1))]
    while len(levels[-1][2]) > len(np.unique(levels[-1][2])):
        shared, pattern, g, _ = levels[-1]
        new = np.concatenate(([True], g[1:] != g[:-1]))
        first = np.flatnonzero(new)
        within = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
        heads = np.flatnonzero(within % FAN_OUT == 0)
        ones, zeros = np.bitwise_and.reduceat(pattern | ~shared, heads), np.bitwise_or.reduceat(pattern & shared, heads)
        # A bit is shared if all children share it and have it alike.
        keep = np.bitwise_and.reduceat(shared, heads) & ~(ones ^ zeros)
        levels.append((keep, zeros & keep, g[heads], np.append(heads, len(g))))
    roots = np.arange(len(levels[-1][2]))
    stack = [(len(levels) - 1, roots, roots)]
    while stack:
        level, a, b = stack.pop()
        if len(a) > PAIRS_AT_A_TIME:
            half = len(a) // 2
            stack += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
            continue
        if level == 0:
            apart = a < b
            if apart.any():
                yield a[apart], b[apart]
            continue
        first = levels[level][3]
        shared, pattern, *_ = levels[level - 1]
        i, j = np.divmod(np.arange(FAN_OUT * FAN_OUT), FAN_OUT)
        x, y = (first[a][:, None] + i).ravel(), (first[b][:, None] + j).ravel()
        there = (x < np.repeat(first[a + 1], FAN_OUT**2)) & (y < np.repeat(first[b + 1], FAN_OUT**2)) & (x <= y)
        x, y = x[there], y[there]
        near = np.bitwise_count((pattern[x] ^ pattern[y]) & shared[x] & shared[y]) <= radius
        stack.append((level - 1, x[near], y[near]))


def _linker(radius: int):
    """Stars of each group, for rows that come sorted by mask and pattern."""

    def of(mask: np.ndarray, pattern: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
        unsigned = fp.view(np.uint64)
        order = np.lexsort((gray_rank(unsigned), pattern, mask))
        mask, pattern, unsigned, rep = mask[order], pattern[order], unsigned[order], rep[order]
        group = np.cumsum(np.concatenate(([0], (mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1]))))
        stars = Stars(len(unsigned))
        for a, b in links(unsigned, group, radius):
            stars.link(a, b)
        (linked,) = np.nonzero(stars.top != np.arange(len(stars.top)))
        return pa.RecordBatch.from_arrays([pa.array(rep[stars.top[linked]]), pa.array(rep[linked])], ["a", "b"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append([b.column(c).to_numpy() for c in ("mask", "pattern", "fp", "rep")])
            rows = [np.concatenate(c) for c in zip(*held, strict=True)]
            change = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]))
            if len(change):  # the last group may go on in the next batch
                whole = change[-1] + 1
                yield of(*(c[:whole] for c in rows))
                rows = [c[whole:] for c in rows]
            held = [rows]
        if held:
            yield of(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return search


#: Tasks over which the edges of a node are dealt.
SALTS = 8


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _finer(varying: Column, n: int) -> Column:
    """Masks of a group whose members differ in the bits of ``varying`` alone: all other bits and one block of these."""

    @F.pandas_udf("array<long>")
    def of(bits: pd.Series) -> pd.Series:
        return pd.Series([[_signed(ALL & ~v | block) for block in blocks_of(v, n)] for v in (x % (1 << 64) for x in bits.tolist())])

    return of(varying)


def near_links(nodes: DataFrame, radius: int = 4, largest_group: int = LARGEST_GROUP) -> DataFrame:
    """Links (a, b) of reps of distinct fingerprints that join all that differ in at most ``radius`` bits, directly or by a chain
    of such steps. ``nodes``: fp, rep, one row a fingerprint. ``largest_group`` is at least 2 ** (radius + 1)."""
    top = F.array(*[F.lit(_signed(m)).cast("long") for m in blocks_of(ALL, radius + 1)])
    level, found = nodes.select("fp", "rep", top.alias("masks")), None
    while True:
        rows = level.select("fp", "rep", F.explode("masks").alias("mask"))
        rows = (rows if found is None else rows.distinct()).withColumn("pattern", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = rows.groupBy("mask", "pattern").agg(F.count("*").alias("n"), F.bit_or("fp").bitwiseXOR(F.bit_and("fp")).alias("varying"))
        large = checkpointed(sizes.where(F.col("n") > largest_group).select("mask", "pattern", _finer(F.col("varying"), radius + 1).alias("masks")))
        deep = not large.isEmpty()
        # A group of one has no links; over-large groups go one level down, where the bits in which members differ are cut up. Those
        # are hot keys, so rows learn whether they are in one by a join that spreads them.
        told = join_stats(rows, large, ["mask", "pattern"], F.col("fp")) if deep else rows
        small = told.where("masks is null") if deep else rows
        star = small.select("mask", "pattern", "fp", "rep").repartition("mask", "pattern").sortWithinPartitions("mask", "pattern").mapInArrow(_linker(radius), "a long, b long")
        found = star if found is None else found.unionByName(star)
        if not deep:
            return found.distinct()
        # Groups under different masks can have the same members, and so the same finer masks.
        level = checkpointed(told.where("masks is not null").select("fp", "rep", "masks").distinct())


def components(links_: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of ``links_`` (a, b), by alternating large and small stars."""
    edges = checkpointed(links_.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    # Done when a round changes nothing: as many edges, with the same exclusive or of their hashes.
    while state != (state := tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())):
        # Large star: each node hands its larger neighbours to the smallest node it knows.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # A node may have a third of all edges, so its edges are dealt over SALTS tasks, each of which is told what is known of it.
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        large = both.where("v > u").withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(least, ["u", "salt"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: each node hands its smaller neighbours, and itself, to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = checkpointed(small.distinct())
    pairs = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))


def near_duplicates(docs: DataFrame, radius: int = 4, words: int = 4, id_col: str = "doc_id", text_col: str = "text", largest_group: int = LARGEST_GROUP) -> DataFrame:
    """``id_col``, fingerprint (16 hex digits), component_id of every row of ``docs``; ids are whole numbers.

    component_id is the smallest id reachable over texts whose fingerprints differ in at most ``radius`` bits. Equal
    fingerprints are one node under their smallest id, so copies never make pairs.

    Edge cases: a null or wordless text has the fingerprint 0, linked like any other; a text with fewer than ``words`` words
    is one shingle. A row with a null id links nothing and gets the component of its fingerprint, if other rows have that, or
    null. Repeated rows stay; an empty table gives no rows; other columns are not read.
    """
    rows = checkpointed(fingerprints(docs, id_col, text_col, words))
    nodes = checkpointed(rows.where("id is not null").groupBy("fp").agg(F.min("id").cast("long").alias("rep")))
    joined = components(near_links(nodes, radius, largest_group))
    of = nodes.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(of, "fp", "left")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
