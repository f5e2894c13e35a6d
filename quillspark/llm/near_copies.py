"""Near copies by exact shingle similarity, for stages that must join all texts of a given Jaccard similarity.

Candidates come from SimHash fingerprints of the shingles, by the index and the stars of ``simhash``: those within a few bits of each
other. Candidates are links once their sets of shingles have the similarity.

At a similarity of 0.8 fingerprints differ in a sixth of their bits, more than block masks can stand. So what they leave apart meets
by MinHash bands: texts that share ``ROWS`` minima under one of ``BANDS`` bands meet in a bucket. At 0.8 a pair is missed with
probability (1 - 0.8 ** 5) ** 25 = 0.00005, above it less.

Buckets can be large: templates share bands without being similar. If there is much to compare, all members of a bucket are
compared with one head of it, one that meets others in as many buckets as any and so is near to most; what is in one component
needs no link of its own. What is left then meets in blocks: tasks of two blocks of a bucket compare bitmaps of shingles, not texts. Each
bit that one bitmap has and the other lacks is a shingle that the other text lacks, which bounds from above what two texts share, so
that no link is lost, and only pairs that the bound allows leave the task to have their sets compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import checkpointed, join_stats, written
from quillspark.llm.simhash import SEED, components, majority, near_links

BANDS, ROWS, AT_A_TIME = 25, 5, 1 << 12
#: Pairs a text from which on members meet heads first.
FEW = 1
#: Members of a block, bits of the smallest bitmap as a power of two, and 64-bit words that are compared at a time.
BLOCK_ROWS, LEAST_BITS, WORDS_AT_A_TIME = 2048, 10, 1 << 21
_rng = np.random.default_rng(SEED)
_XOR, _TIMES = (_rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) for _ in range(2))
_TIMES = _TIMES | np.uint64(1)


def hashes(text: str, words: int) -> np.ndarray:
    """Hashes of the shingles, repeats included, made as for fingerprints; a text with fewer words is one shingle."""
    import xxhash

    tokens = text.encode().lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    n, hash_ = max(1, len(tokens) - words + 1), xxhash.xxh64_intdigest
    return np.fromiter((hash_(b" ".join(tokens[i : i + words]), SEED) for i in range(n)), np.uint64, n)


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct ``hashes``."""
    return np.unique(hashes(text, words))


def bands(hashes: np.ndarray) -> list[int]:
    """A bucket for each band; none for no shingles."""
    import xxhash

    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), AT_A_TIME):
        least = np.minimum(least, ((hashes[i : i + AT_A_TIME, None] ^ _XOR) * _TIMES).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64).tolist()


def _sketch(words: int):
    @F.pandas_udf("node binary, fp long, buckets array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            all_ = hashes(text or "", words)
            set_ = np.unique(all_)
            rows.append((hashlib.md5(set_.tobytes()).digest(), majority(all_), bands(set_)))
        node, fp, buckets = zip(*rows, strict=True) if rows else ((), (), ())
        return pd.DataFrame({"node": node, "fp": np.array(fp, np.uint64).view(np.int64), "buckets": buckets})

    return of


def bitmap(hashes: np.ndarray) -> bytes:
    """A bit for the low bits of each hash: four places a shingle at least, as a power of two. Half of a bitmap or'ed with the other
    half is that of half the size."""
    size = 1 << max(LEAST_BITS, int(4 * len(hashes) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[(hashes & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _sets(words: int):
    @F.pandas_udf("n int, bits binary, set array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        sets = [shingles(t or "", words) for t in texts]
        return pd.DataFrame({"n": [len(s) for s in sets], "bits": [bitmap(s) for s in sets], "set": [s.view(np.int64) for s in sets]})

    return of


def _allowed(n_x: np.ndarray, n_y: np.ndarray, bits_x: np.ndarray, bits_y: np.ndarray, both: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of n_x and n_y shingles, with so many bits each and in both, can have the similarity."""
    shared = np.minimum(n_x - (bits_x - both), n_y - (bits_y - both))
    return shared * (1 + similarity) + 1e-6 >= similarity * (n_x + n_y)


def allowed_pairs(n: np.ndarray, bits: list[bytes], similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of all pairs of sets, of n shingles and such bitmaps each, that the bound allows; only those of sizes that are
    near enough are compared."""
    order = np.argsort(n, kind="stable")
    size = np.array([len(bits[i]) for i in order])
    kinds = {k: (order[size == k], np.stack([np.frombuffer(bits[i], np.uint64) for i in order[size == k]])) for k in np.unique(size).tolist()}
    for k, (x, xs) in kinds.items():
        for k_y, same in ((k, True), (2 * k, False)):  # sizes within a similarity of over a half differ by one power of two at most
            if k_y not in kinds:
                continue
            y, ys = kinds[k_y]
            ys = ys if same else ys[:, : xs.shape[1]] | ys[:, xs.shape[1] :]
            bits_x, bits_y = np.bitwise_count(xs).sum(axis=1, dtype=np.int64), np.bitwise_count(ys).sum(axis=1, dtype=np.int64)
            step = max(1, WORDS_AT_A_TIME // (len(y) * xs.shape[1]))
            for at in range(0, len(x), step):
                some = slice(at, min(at + step, len(x)))
                low = at if same else 0
                high = int(np.searchsorted(n[y], n[x[some.stop - 1]] / similarity + 1e-6, side="right"))
                if high <= low:
                    continue
                near = slice(low, high)
                both = np.bitwise_count(xs[some, None, :] & ys[None, near, :]).sum(axis=2, dtype=np.int64)
                ok = _allowed(n[x[some], None], n[y[near]][None, :], bits_x[some, None], bits_y[near][None, :], both, similarity)
                i, j = np.nonzero(ok)
                i, j = i + at, j + low
                keep = i < j if same else np.ones(len(i), bool)
                if keep.any():
                    yield x[i[keep]], y[j[keep]]


def _by_fingerprint(nodes: DataFrame, radius: int) -> DataFrame:
    """(a, b) of ``nodes`` (node, fp) that fingerprints bring together: all of one fingerprint meet its first node, and the first nodes
    of fingerprints that the index links meet. They are as many as nodes and stars, whatever a group holds."""
    points = checkpointed(nodes.groupBy("fp").agg(F.min("node").alias("head")))
    head = lambda c, to: points.select(F.col("fp").alias(c), F.col("head").alias(to))
    # A star's centre, and a fingerprint that many share, are hot keys.
    found = join_stats(near_links(points.select("fp", F.col("fp").alias("rep")), radius), head("a", "x"), ["a"], F.col("b"))
    apart = join_stats(found, head("b", "y"), ["b"], F.col("a")).select("x", "y")
    alike = join_stats(nodes.select("node", "fp"), head("fp", "y"), ["fp"], F.col("node")).where(F.col("node") != F.col("y")).select(F.col("node").alias("x"), "y")
    return checkpointed(apart.unionByName(alike).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())


def _meeting(similarity: float):
    """Pairs of nodes that the bound allows, from each (bucket, low, high) on its own; rows come sorted by these. Those of one
    component need no link, and those of one block meet where that block is by itself."""

    def of(group: pa.Table) -> pa.RecordBatch | None:
        n, bits = group["n"].to_numpy(), group["bits"].to_pylist()
        part, block = group["component"].combine_chunks().dictionary_encode().indices.to_numpy(), group["block"].to_numpy()
        apart = group["low"][0].as_py() != group["high"][0].as_py()
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i, j in allowed_pairs(n, bits, similarity):
            keep = (part[i] != part[j]) & ((block[i] != block[j]) | (not apart))
            a.append(i[keep])
            b.append(j[keep])
        node = group["node"].combine_chunks()
        return pa.RecordBatch.from_arrays([node.take(pa.array(np.concatenate(a))), node.take(pa.array(np.concatenate(b)))], ["a", "b"])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            table = pa.Table.from_batches([*held, b])
            key = [table[c].to_numpy() for c in ("bucket", "low", "high")]
            cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
            starts = [0, *cuts.tolist()]
            for at, to in zip(starts, starts[1:], strict=False):
                if to - at > 1:
                    yield of(table.slice(at, to - at))
            held = table.slice(starts[-1]).combine_chunks().to_batches()  # the last group may go on in the next batch
        if held and sum(b.num_rows for b in held) > 1:
            yield of(pa.Table.from_batches(held))

    return over


def _met(open_: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of different components in a bucket of ``open_`` (bucket, node, component, members) that the bound allows."""
    blocks = F.ceil(F.col("members") / BLOCK_ROWS).cast("int")
    dealt = open_.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "component")
    rows = dealt.join(sets.select("node", "n", "bits"), "node").repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    return rows.select("bucket", "low", "high", "block", "node", "component", "n", "bits").mapInArrow(_meeting(similarity), "a binary, b binary")


def _bounded(similarity: float):
    """(a, b) of the pairs whose bitmaps allow the similarity."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("bits_x").to_pylist(), batch.column("bits_y").to_pylist()
            n_x, n_y = batch.column("n_x").to_numpy(), batch.column("n_y").to_numpy()
            ok = np.zeros(batch.num_rows, bool)
            for i, pair in enumerate(zip(x, y, strict=True)):
                u, v = (np.frombuffer(p, np.uint64) for p in pair)
                while len(u) != len(v):
                    u, v = (w if len(w) <= min(len(u), len(v)) else w[: len(w) // 2] | w[len(w) // 2 :] for w in (u, v))
                count = [int(np.bitwise_count(w).sum(dtype=np.int64)) for w in (u, v, u & v)]
                ok[i] = _allowed(n_x[i], n_y[i], *count, similarity)
            yield batch.filter(pa.array(ok)).select(["a", "b"])

    return over


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets of shingles have the similarity."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("set").alias(f"set_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return checkpointed(both.where(shared >= F.lit(similarity) * (F.size("set_a") + F.size("set_b") - shared)).select("a", "b"))


def row_key(id_: Column, text: Column) -> Column:
    """One string for each id and text; rows alike in both share it."""
    part = lambda c: F.coalesce(F.concat(F.lit("s"), F.md5(c.cast("string"))), F.lit("n"))
    return F.concat(part(id_), part(text))


def near_copies(docs: DataFrame, similarity: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """key (``row_key``) and component of every distinct row of ``docs``, with keep for one key of each component.

    Rows belong together if their ``words``-word shingles have a Jaccard similarity of ``similarity`` (over 0.5) or more, directly or
    by a chain. The key that stays has the smallest id, null after all others, then the smallest text hash. Fingerprints meet
    within ``radius`` bits; bands join what these leave apart, so the radius doesn't change what belongs together.

    Edge cases: null and wordless texts are one component; a text with fewer words is one shingle. Texts with the same set of
    shingles are one node however often they come, and long ones have larger bitmaps. Rows that share an id but not a text are
    rows of their own; rows that are alike in both are one. An empty table gives no rows; other columns are not read.
    """
    if not 0.5 < similarity <= 1:
        raise ValueError("a similarity is over 0.5 and at most 1")
    id_, text = F.col(id_col), F.col(text_col)
    found = docs.select(row_key(id_, text).alias("key"), id_.alias("id"), _sketch(words)(text).alias("s")).select("key", "id", "s.*")
    rows = checkpointed(found)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first")
    nodes = checkpointed(rows.groupBy("node").agg(first, F.min("fp").alias("fp"), F.first("buckets").alias("buckets")))
    near = _by_fingerprint(nodes, radius)
    member = nodes.select("node", F.explode("buckets").alias("bucket"))
    member = checkpointed(member.join(member.groupBy("bucket").count().where("count > 1").select("bucket"), "bucket"))
    # Only texts that meet another are read again.
    seen = member.select("node", F.lit(1).alias("n"))
    for side in "ab":
        seen = seen.unionByName(near.select(F.col(side).alias("node"), F.lit(0).alias("n")))
    meet = seen.groupBy("node").agg(F.sum("n").alias("meets")).join(nodes.select("node", "first.key"), "node")
    texts = docs.select(row_key(id_, text).alias("key"), text.alias("text")).join(meet, "key").dropDuplicates(["node"])
    sets = written(texts.select("node", "meets", _sets(words)("text").alias("s")).select("node", "meets", "s.*"))
    links = joined = None
    for last in (False, True):
        named = member.withColumn("component", F.col("node")) if joined is None else member.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
        parts = named.groupBy("bucket", "component").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("largest"), F.sum("n").alias("members"), F.count("*").alias("parts"))
        open_ = checkpointed(named.join(parts.where("parts > 1").select("bucket", "members", "largest"), "bucket"))
        outside = F.col("component") != F.col("largest.component")
        left = open_.where(outside).agg(F.coalesce(F.sum(F.col("members") - 1), F.lit(0))).first()[0]
        if not left and near is None:
            break
        last = last or left <= FEW * nodes.count()
        if last:
            pairs = _met(open_, sets, similarity)
        else:
            central = F.struct(-F.col("meets"), F.xxhash64("node").alias("order"), "node", "component")
            heads = open_.where(outside).join(sets.select("node", "meets"), "node").groupBy("bucket").agg(F.min(central).alias("head"))
            pairs = open_.join(heads, "bucket").where(F.col("component") != F.col("head.component")).select(F.col("node").alias("x"), F.col("head.node").alias("y"))
        pairs = pairs.select(F.least(*pairs.columns).alias("a"), F.greatest(*pairs.columns).alias("b"))
        if near is not None:  # the first round's
            pairs, near = pairs.unionByName(near), None
        pairs = pairs.distinct()
        if not last:
            side = lambda c, to: sets.select(F.col("node").alias(c), F.col("n").alias(f"n_{to}"), F.col("bits").alias(f"bits_{to}"))
            pairs = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").mapInArrow(_bounded(similarity), "a binary, b binary")
        new = _verified(checkpointed(pairs), sets, similarity)
        if not new.isEmpty():
            links = new if links is None else links.unionByName(new)
            joined = checkpointed(components(links))
        if last:
            break
    if joined is None:  # no text is similar to another
        joined = nodes.select("node", F.col("node").alias("component")).limit(0)
    whole = checkpointed(nodes.join(joined, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component")))
    kept = whole.groupBy("component").agg(F.min("first").alias("kept"))
    keys = rows.select("key", "node").distinct().join(whole.select("node", "component"), "node").join(kept, "component")
    return keys.select("key", "component", (F.col("key") == F.col("kept.key")).alias("keep"))
