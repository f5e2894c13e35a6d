"""Phrases that stand together oftener than their parts explain, by hashed bucket counts (PCY, DHP) and Apriori pruning.

There is one pass over the texts for each length. The pass for n words counts n-grams exactly, and by the way throws the (n + 1)-grams
that may matter into buckets. A bucket's count bounds those of all it holds, so only n-grams in full buckets (a bitmap), whose two
(n - 1)-grams are frequent (another bitmap, of the exact counts), are counted in the next pass. Bitmaps have a fixed size, so they are
broadcast whatever the corpus; what they let through in error is counted exactly and falls away. Bucket counts stop at the support
that is asked for, beyond which they can't tell more, so that they stay small on their way.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import join_stats, written

#: Bits of a bucket's number, and of its place in a chunk; tasks whose chunks meet first; bytes of text that are taken at a time.
BUCKET_BITS, CHUNK_BITS, FAN_IN, BATCH_BYTES = 24, 16, 1024, 8_000_000
#: What ends a piece, of which the first stands for all, and the language of texts without one.
ENDS, NO_LANGUAGE = b".,;:!?\n\x0b\x0c\r", "und"
_ENDED, _TIMES, _SPREAD = bytes.maketrans(ENDS, ENDS[:1] * len(ENDS)), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_PASS = "lang string, phrase string, n long, hash long, chunk int, task int, counts binary"
_CHUNK = "chunk int, task int, counts binary"


class _Places(dict):
    """The place of each word by when it came; what ends a piece is 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self)
        return place


def tokens(texts: list[str]) -> list[bytes]:
    """Words of all texts, with ``ENDS[:1]`` where a piece ends."""
    end = b" " + ENDS[:1] + b" "
    return end.join(t.encode() for t in texts).lower().translate(_ENDED).replace(ENDS[:1], end).split()


def start_of(lang: str) -> np.uint64:
    import xxhash

    return np.uint64(xxhash.xxh64_intdigest(lang.encode(), 1))


def hashes_of(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def longer(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases and one word more."""
    return hashes * _TIMES + words


def bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    return ((hashes ^ (hashes >> np.uint64(29))) * _SPREAD >> np.uint64(64 - bits)).astype(np.int64)


class Batch:
    """The texts of one language: their words by place, and what of them may be counted."""

    def __init__(self, lang: str, texts: list[str]):
        places = _Places({ENDS[:1]: 0})
        words = tokens(texts)
        self.at = np.fromiter(map(places.__getitem__, words), np.int64, len(words))
        self.vocabulary = list(places)
        self.word = hashes_of(self.vocabulary)[self.at]
        self.inside = self.at != 0
        self.start = start_of(lang)

    def hashes(self, n: int) -> np.ndarray:
        """Of the n-gram at each place from which on there are n tokens."""
        out = np.full(len(self.word), self.start, np.uint64)
        for k in range(n):
            out = longer(out[: max(len(self.word) - k, 0)], self.word[k:])
        return out

    def whole(self, n: int) -> np.ndarray:
        """Whether the n tokens at each place are words of one piece."""
        out = self.inside
        for k in range(1, n):
            out = out[: max(len(self.inside) - k, 0)] & self.inside[k:]
        return out

    def candidates(self, n: int, frequent: np.ndarray | None, full: np.ndarray | None, bits: int) -> np.ndarray:
        """Whether the n-gram at each place may be frequent: both its (n - 1)-grams are, and its bucket is full."""
        out = self.whole(n)
        if n > 1:
            known = frequent[bucket(self.hashes(n - 1), bits)]
            out = out & known[:-1][: len(out)] & known[1:][: len(out)]
            (open_,) = np.nonzero(out)
            out = np.zeros(len(out), bool)
            out[open_] = full[bucket(self.hashes(n)[open_], bits)]
        return out

    def count(self, n: int, places: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(phrase, times, hash) of each n-gram at ``places``. n-grams are told apart by their words, pair by pair, not by hashes."""
        pair = lambda a, b: pd.factorize((a << 32) | b)[0].astype(np.int64)
        key = self.at[places]
        for k in range(1, n):
            key = pair(key, self.at[places + k])
        _, first, times = np.unique(key, return_index=True, return_counts=True)
        spots = places[first]
        columns = [[self.vocabulary[w] for w in self.at[spots + k].tolist()] for k in range(n)]
        return [b" ".join(ws).decode() for ws in zip(*columns, strict=True)], times, self.hashes(n)[spots]


def _chunks(counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """Rows of the chunks that hold something."""
    size = 1 << min(CHUNK_BITS, bits)
    there = [(i, counts[i * size : (i + 1) * size]) for i in range(len(counts) // size)]
    there = [(i, zlib.compress(c.tobytes(), 1)) for i, c in there if c.any()]
    task = TaskContext.get().partitionId()
    none = lambda kind: pa.nulls(len(there), kind)
    return pa.RecordBatch.from_arrays([none(pa.string()), none(pa.string()), none(pa.int64()), none(pa.int64()), pa.array([i for i, _ in there], pa.int32()), pa.array([task] * len(there), pa.int32()), pa.array([c for _, c in there], pa.binary())], ["lang", "phrase", "n", "hash", "chunk", "task", "counts"])


def _pass(n: int, last: bool, least: int, bits: int, frequent: bytes | None, full: bytes | None):
    """Counts of n-grams by batch, then the task's bucket counts of (n + 1)-grams."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = lambda b: None if b is None else np.unpackbits(np.frombuffer(b, np.uint8)).astype(bool)
        frequent_, full_ = opened(frequent), opened(full)
        counts = None if last else np.zeros(1 << bits, np.uint32)
        held: dict[str, list[str]] = defaultdict(list)
        size = 0

        def closed() -> Iterator[pa.RecordBatch]:
            for lang, texts in held.items():
                batch = Batch(lang, texts)
                may = batch.candidates(n, frequent_, full_, bits)
                phrases, times, hashes = batch.count(n, np.flatnonzero(may))
                none = lambda kind: pa.nulls(len(phrases), kind)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.string()), pa.array(times, pa.int64()), pa.array(hashes.view(np.int64)), none(pa.int32()), none(pa.int32()), none(pa.binary())], ["lang", "phrase", "n", "hash", "chunk", "task", "counts"])
                if not last:
                    (next_,) = np.nonzero(may[:-1] & may[1:] & batch.whole(n + 1)[: max(len(may) - 1, 0)])
                    np.add.at(counts, bucket(batch.hashes(n + 1)[next_], bits), np.uint32(1))
                    np.minimum(counts, least, out=counts)

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                held[lang].append(text)
                size += len(text)
                if size >= BATCH_BYTES:
                    yield from closed()
                    held.clear()
                    size = 0
        yield from closed()
        if not last:
            yield _chunks(counts.astype(np.min_scalar_type(least)), bits)

    return over


def _meeting(least: int, bits: int, end: bool):
    """The sum of a chunk's counts, up to ``least``; in the ``end`` a bit for each that reaches it."""
    kind = np.min_scalar_type(least)

    def meet(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << min(CHUNK_BITS, bits), np.uint32)
        for c in table["counts"]:
            np.minimum(total + np.frombuffer(zlib.decompress(c.as_py()), kind), least, out=total)
        body = np.packbits(total >= least).tobytes() if end else zlib.compress(total.astype(kind).tobytes(), 1)
        return pa.table({"chunk": table["chunk"].slice(0, 1), "task": pa.array([table["task"][0].as_py() // FAN_IN], pa.int32()), "counts": pa.array([body], pa.binary())})

    return meet


def bitmap(chunks: DataFrame, least: int, bits: int) -> bytes:
    """A bit for each of 2 ** ``bits`` buckets: whether its counts in ``chunks`` reach ``least`` together. A task's chunks meet those of
    ``FAN_IN`` others first, so no task holds those of all."""
    some = chunks.groupBy("chunk", F.floor(F.col("task") / FAN_IN)).applyInArrow(_meeting(least, bits, False), _CHUNK)
    size, out = 1 << max(min(CHUNK_BITS, bits) - 3, 0), bytearray(1 << (bits - 3))
    for r in some.groupBy("chunk").applyInArrow(_meeting(least, bits, True), _CHUNK).collect():
        out[r["chunk"] * size : (r["chunk"] + 1) * size] = r["counts"]
    return bytes(out)


def _marked(bits: int):
    """Chunks with a one in the bucket of each hash."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint8)
        for b in batches:
            counts[bucket(b.column("hash").to_numpy().view(np.uint64), bits)] = 1
        yield _chunks(counts, bits).select(["chunk", "task", "counts"])

    return over


def frequent_phrases(docs: DataFrame, most_words: int, least: int, bits: int = BUCKET_BITS, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f of all phrases of up to ``most_words`` words with f of ``least`` or more; lang, n of all words)."""
    if not 3 <= bits <= 32 or least < 1:
        raise ValueError("buckets have numbers of 3 to 32 bits, and a support is 1 or more")
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit(NO_LANGUAGE)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    frequent = full = found = totals = None
    for n in range(1, most_words + 1):
        last = n == most_words
        counted = written(texts.mapInArrow(_pass(n, last, least, bits, frequent, full), _PASS))
        grams = counted.where("chunk is null")
        if n == 1:
            totals = grams.groupBy("lang").agg(F.sum("n").alias("n"))
        exact = written(grams.groupBy("lang", "phrase").agg(F.sum("n").alias("f"), F.first("hash").alias("hash")).where(F.col("f") >= least).withColumn("words", F.lit(n)))
        found = exact if found is None else found.unionByName(exact)
        if not last:
            full = bitmap(counted.where("chunk is not null").select("chunk", "task", "counts"), least, bits)
            frequent = bitmap(exact.select("hash").mapInArrow(_marked(bits), _CHUNK), 1, bits)
    return found.drop("hash"), totals


def _run(words: Column, first: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(words, F.lit(first) if isinstance(first, int) else first, F.lit(n) if isinstance(n, int) else n), " ")


def scored(found: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, score of phrases of two words and more, by the cut that scores lowest."""
    cuts = found.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "words", "a", "k", _run(F.col("w"), 1, F.col("k")).alias("left"), _run(F.col("w"), F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):  # a common word is a part of many phrases
        cuts = join_stats(cuts, found.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side], F.col("phrase"), salts=8)
    score = F.expr("cast(cast(a as decimal(20, 0)) * 2000000bd div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0))) as long)")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return cuts.groupBy("lang", "phrase", "words", "a").agg(lowest).select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, top: int = 2000, most_words: int = 4, least: int = 30, cover_percent: int = 80, bits: int = BUCKET_BITS, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: each language's ``top`` phrases of 2 to ``most_words`` words by score, then a,
    then the phrase's bytes.

    Words are what stands between spaces and tabs in a piece of the text without ``ENDS``, A-Z lower-cased. a is how often the phrase
    stands in the language, ``least`` times or more; l and r how often the parts do into which it is cut, so that the score,
    floor(2000000 * a / (l + r)), is lowest; n is the number of all words. A phrase goes if a longer one holds it ``cover_percent``
    times in a hundred or more.

    Edge cases: null languages are ``NO_LANGUAGE``; null, empty and wordless texts have no phrases. Repeated rows count each; an
    empty table gives no rows; other columns are not read. ``bits`` bounds memory and broadcasts alone and changes no result.
    """
    found, totals = frequent_phrases(docs, most_words, least, bits, lang_col, text_col)
    spots = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("words") - k + 1), lambda i: _run(F.col("w"), i, k))))
    inner = found.where("words > 2").select("lang", "words", "f", F.split("phrase", " ").alias("w")).select("lang", "f", F.explode(spots).alias("phrase"))
    held = inner.groupBy("lang", "phrase").agg(F.max("f").alias("held"))
    kept = scored(found).join(held, ["lang", "phrase"], "left").where(F.col("held").isNull() | (F.col("held") * 100 < F.col("a") * cover_percent))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # The best of each part of a language first, so that what meets is bounded.
    some = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(32))).orderBy(*order))
    best = kept.withColumn("place", some).where(F.col("place") <= top)
    listed = best.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("low"), (-F.col("a")).alias("rare"), "phrase", "l", "r"))), 1, top).alias("all"))
    each = listed.join(totals, "lang").select("lang", "n", F.posexplode("all").alias("at", "x"))
    return each.select("lang", (F.col("at") + 1).cast("long").alias("rank"), "x.phrase", (-F.col("x.rare")).alias("a"), "x.l", "x.r", "n", (-F.col("x.low")).alias("score"))
