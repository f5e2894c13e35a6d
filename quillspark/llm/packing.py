"""Harmonic packing of token ids into sequences of one capacity.

A piece is in class j if its length is above capacity / (j + 1) and at most capacity / j; a bin of class j holds j pieces. Pieces
of at most capacity / CLASSES are the last class, whose bins are filled one after the other. A document is whole capacities and a
rest. The rest stays whole where the padding that its class costs a piece is little for the document; else what fills a class is
cut from it, until what is left is small or fits well. Each task fills the bins of its own rows and needs nothing from others. What
stays in bins that aren't full at its end, less than one bin a class, is laid end to end and cut at the capacity, the rest at
powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.memo import word_ids

#: Tokens are unsigned 32-bit, little-endian.
ID_BYTES = 4
OUT = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


#: Classes of bins, the last of them for all that is smaller, and the part of a document that padding may be.
CLASSES, PADDING = 16, 0.01


def cut(length: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces in order."""
    whole, rest = divmod(length, capacity)
    pieces = [capacity] * whole
    while rest * CLASSES > capacity and (capacity - capacity // rest * rest) / (capacity // rest) > PADDING * length:
        pieces.append(capacity // (capacity // rest + 1))
        rest -= pieces[-1]
    return pieces + [rest] * (rest > 0)


class Packer:
    """Bins of one task. Pieces are (row, start, ids as bytes)."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.next = capacity, first_sequence
        self.bins: dict[int, list] = defaultdict(list)
        self.small: list = []
        self.room = capacity

    def _close(self, pieces: list) -> Iterator[tuple]:
        offset = 0
        for row, start, ids in pieces:
            yield row, start, len(ids) // ID_BYTES, zlib.crc32(ids), self.next, offset
            offset += len(ids) // ID_BYTES
        self.next += 1

    def add(self, row: tuple, ids: bytes) -> Iterator[tuple]:
        start = 0
        for length in cut(len(ids) // ID_BYTES, self.capacity):
            piece, fits = (row, start, ids[start * ID_BYTES : (start + length) * ID_BYTES]), self.capacity // length
            start += length
            if fits >= CLASSES:
                yield from self._add_small(piece, length)
                continue
            pieces = self.bins[fits]
            pieces.append(piece)
            if len(pieces) == fits:
                yield from self._close(self.bins.pop(fits))

    def _add_small(self, piece: tuple, length: int) -> Iterator[tuple]:
        """To the last class's bin; what doesn't fit in it begins the next."""
        row, start, ids = piece
        fits = min(length, self.room)
        self.small.append((row, start, ids[: fits * ID_BYTES]))
        self.room -= fits
        if not self.room:
            yield from self._close(self.small)
            self.small, self.room = [], self.capacity
            if fits < length:
                self.small.append((row, start + fits, ids[fits * ID_BYTES :]))
                self.room -= length - fits

    def finish(self) -> Iterator[tuple]:
        left = [p for _, pieces in sorted(self.bins.items()) for p in pieces] + self.small
        rest = sum(len(ids) for *_, ids in left) // ID_BYTES
        at, used = 0, 0
        while rest:
            room = self.capacity if rest >= self.capacity else 1 << (rest.bit_length() - 1)
            rest, pieces = rest - room, []
            while room:
                row, start, ids = left[at]
                take = min(room, len(ids) // ID_BYTES - used)
                pieces.append((row, start + used, ids[used * ID_BYTES : (used + take) * ID_BYTES]))
                room, used = room - take, used + take
                if used * ID_BYTES == len(ids):
                    at, used = at + 1, 0
            yield from self._close(pieces)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", batch_chars: int = 4_000_000) -> DataFrame:
    """One row for each piece: ``id_col``, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of its whole text and then ``end_id``. The tokenizer must split at white space and drop it.
    Sequences have ``capacity`` tokens, padding included, or a power of two without padding. Ids of sequences begin with the
    task's number, so that they are the same when a lost task runs again over the same rows.

    Edge cases: a null or empty text is ``end_id`` alone. Null ids and repeated rows are documents of their own; an empty
    table gives no rows; other columns are not read.
    """

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = word_ids(tokenizer_path)
        end, packer = end_id.to_bytes(ID_BYTES, "little"), Packer(capacity, TaskContext.get().partitionId() << 40)

        def rows_of(packed: list[tuple]) -> pd.DataFrame:
            columns = {"__id": pd.Series([p[0][0] for p in packed], dtype="object"), "start": [p[1] for p in packed], "length": [p[2] for p in packed], "ids_crc32": [p[3] for p in packed], "doc_tokens": [p[0][1] for p in packed], "sequence_id": [p[4] for p in packed], "offset": [p[5] for p in packed]}
            return pd.DataFrame(columns)

        for frame in frames:
            for _, part in frame.groupby(frame["__text"].str.len().cumsum() // batch_chars, sort=False):
                split = [memo.split(t) for t in part["__text"]]
                packed = []
                for ident, found in zip(part["__id"].tolist(), memo.values(split), strict=True):
                    ids = b"".join(found) + end
                    packed += packer.add((ident, len(ids) // ID_BYTES), ids)
                if packed:
                    yield rows_of(packed)
        if packed := list(packer.finish()):
            yield rows_of(packed)

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).cast("string").alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    out = rows.mapInPandas(pack, "__id string, " + ", ".join(f"{c} long" for c in OUT))
    return out.select(F.col("__id").cast(kind).alias(id_col), *OUT)
