"""Token counts of whole texts; huge ones are encoded in overlapping chunks that are spliced where both agree.

A chunk is encoded with offsets. In the overlap of two neighbours, a position is a proven common boundary if both start a
token there and the text has a space before a non-space there (see ``memo.STABLE``): what follows no longer depends on what
came before. The left chunk counts up to the first such position and the right one from there. Documents with an overlap
that has none are encoded again with wider overlaps, at last whole.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import checkpointed
from quillspark.llm.memo import STABLE, SpacedCounts

#: Texts that a task counts at a time, in characters.
BATCH_CHARS = 4_000_000
#: Chunks of one text that are handed on together.
CHUNKS = 64


def count_many(memo: SpacedCounts, texts: list[str]) -> list[int]:
    """Token counts of texts, as sums over pieces that start at stable boundaries."""
    split = [STABLE.split(text) for text in texts]
    firsts = memo.encode([pieces.pop(0) for pieces in split])
    return [len(first.ids) + sum(counts) for first, counts in zip(firsts, memo.values(split), strict=True)]


def _counter(path: str):
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = SpacedCounts(path)
        for frame in frames:
            group = frame["__text"].str.len().cumsum() // BATCH_CHARS
            for _, part in frame.groupby(group, sort=False):
                yield part.drop(columns="__text").assign(__n=count_many(memo, part["__text"].tolist()))

    return count


def _chunker(chunk: int, overlap: int):
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                n = max(1, -(-len(row.text) // chunk))
                for at in range(0, n, CHUNKS):
                    some = range(at, min(at + CHUNKS, n))
                    yield pd.DataFrame({"ident": row.ident, "hash": row.hash, "chars": row.chars, "chunk": some, "last": [i == n - 1 for i in some], "part": [row.text[i * chunk : (i + 1) * chunk + overlap] for i in some]})

    return cut


def _encoder(path: str, chunk: int, overlap: int):
    """Of each chunk: its tokens, and in both overlaps the stable positions with the number of tokens before each. The overlaps are
    encoded with offsets, up to a stable position beyond them; what lies between is counted by pieces."""

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = SpacedCounts(path)

        def sides(row) -> tuple[int, int]:
            """Where what lies between begins and ends: stable positions, or the end of the text for both."""
            part, high = row.part, len(row.part) if row.last else chunk
            first = STABLE.search(part, overlap if row.chunk else 0, high)
            if first is None:
                return len(part), len(part)
            if row.last:
                return first.start(), high
            at = part.rfind(" ", first.start(), high)
            while not STABLE.match(part, at):
                at = part.rfind(" ", first.start(), at)
            return first.start(), at

        def zones(row, at: int, to: int, between: int) -> tuple:
            part = row.part
            left, right = (memo.tokenizer.encode(t, add_special_tokens=False) for t in (part[:at], part[to:]))
            starts = [a for a, _ in left.offsets]
            before, from_ = len(left.ids) + between, row.chunk * chunk

            def zone(low: int, high: int) -> tuple[list[int], list[int]]:
                spots = [(s, n) for m in STABLE.finditer(part, low, min(high, len(part))) if (n := bisect_left(starts, s := m.start())) < len(starts) and starts[n] == s]
                return [from_ + s for s, _ in spots], [n for _, n in spots]

            head = zone(0, overlap) if row.chunk else ([], [])
            if to < len(part):  # the rest's tokens come after all others
                starts = [to + a for a, _ in right.offsets]
                tail_at, tail_n = zone(chunk, chunk + overlap)
                tail = tail_at, [before + n for n in tail_n]
            else:
                tail = zone(chunk, chunk + overlap)
            return before + len(right.ids), *head, *(([], []) if row.last else tail)

        for frame in frames:
            rows = list(frame.itertuples(index=False))
            cuts = [sides(r) for r in rows]
            pieces = memo.values([STABLE.split(r.part[at:to])[1:] for r, (at, to) in zip(rows, cuts, strict=True)])
            found = [zones(r, at, to, sum(counts)) for r, (at, to), counts in zip(rows, cuts, pieces, strict=True)]
            columns = dict(zip(("n", "head_at", "head_n", "tail_at", "tail_n"), map(list, zip(*found, strict=True)), strict=False)) if found else {}
            yield frame.drop(columns="part").assign(**columns)

    return encode


def _splice(huge: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """Tokens of each text of ``huge`` (ident, hash, chars, text); null where some overlap has no common boundary."""
    key = ["ident", "hash", "chars"]
    cut = huge.mapInPandas(_chunker(chunk, overlap), "ident string, hash long, chars int, chunk int, last boolean, part string")
    spread = cut.repartition(F.col("hash"), F.col("chunk"))
    sides = spread.mapInPandas(_encoder(path, chunk, overlap), "ident string, hash long, chars int, chunk int, last boolean, n long, head_at array<long>, head_n array<long>, tail_at array<long>, tail_n array<long>")
    after = Window.partitionBy(*key).orderBy("chunk")
    pairs = sides.dropDuplicates([*key, "chunk"]).select(*key, "last", "n", "tail_at", "tail_n", F.lead("head_at").over(after).alias("next_at"), F.lead("head_n").over(after).alias("next_n"))
    common = F.array_min(F.array_intersect("tail_at", "next_at"))
    before = lambda at, n: F.get(n, F.array_position(at, F.col("common")).cast("int") - 1)
    pairs = pairs.withColumn("common", common).withColumn("mine", F.when(F.col("last"), F.col("n")).otherwise(before("tail_at", F.col("tail_n")) - before("next_at", F.col("next_n"))))
    return pairs.groupBy(*key).agg(F.when(F.count("*") == F.count("mine"), F.sum("mine")).alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 1 << 16, overlap_chars: int = 512, widen: int = 8) -> DataFrame:
    """``id_col``, n_bytes, n_tokens of every row, as the byte-level BPE tokenizer at ``tokenizer_path`` encodes the whole text.

    Edge cases: null and empty texts have no bytes and no tokens. Texts of over ``chunk_chars`` characters go through chunks;
    one without any stable boundary is at last encoded whole. Null ids and repeated rows stay; an empty table gives no rows;
    other columns are not read.
    """
    # Ids cross over to Python as strings, in which nulls and large numbers stay what they are.
    rows = docs.select(F.col(id_col).cast("string").alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).withColumn("__bytes", F.octet_length("__text").cast("long"))
    kind = dict(docs.dtypes)[id_col]
    short = rows.where(F.length("__text") <= chunk_chars).mapInPandas(_counter(tokenizer_path), "__id string, __bytes long, __n long")
    long_ = rows.where(F.length("__text") > chunk_chars).withColumns({"ident": F.coalesce(F.col("__id"), F.lit("null")), "hash": F.xxhash64("__text"), "chars": F.length("__text")})
    key, todo, overlap, counted = ["ident", "hash", "chars"], long_.select("ident", "hash", "chars", F.col("__text").alias("text")), overlap_chars, []
    while True:
        if overlap >= chunk_chars:  # as good as whole
            whole = todo.withColumnRenamed("text", "__text").mapInPandas(_counter(tokenizer_path), "ident string, hash long, chars int, __n long")
            counted.append(whole.dropDuplicates(key).withColumnRenamed("__n", "n_tokens"))
            break
        spliced = checkpointed(_splice(todo, tokenizer_path, chunk_chars, overlap))
        counted.append(spliced.where("n_tokens is not null"))
        failed = spliced.where("n_tokens is null").select(*key)
        if failed.isEmpty():
            break
        todo, overlap = todo.join(failed, key, "left_semi"), overlap * widen
    of_huge = counted[0]
    for more in counted[1:]:
        of_huge = of_huge.unionByName(more)
    huge = long_.select("__id", "__bytes", *key).join(of_huge, key).select("__id", "__bytes", F.col("n_tokens").alias("__n"))
    return short.unionByName(huge).select(F.col("__id").cast(kind).alias(id_col), F.col("__bytes").alias("n_bytes"), F.col("__n").alias("n_tokens"))
