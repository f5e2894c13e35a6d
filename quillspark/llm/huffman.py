"""Token ids in files, by canonical length-limited Huffman codes.

Texts are encoded once. Ids are counted over all of them, and package-merge gives each a code length of at most ``max_bits``; the
lengths alone are kept, since canonical codes follow from them. Documents are exchanged once into ascending ids and each task
writes its own as files: a header, the documents' lengths, a checkpoint for each block of ``BLOCK`` ids (the bit it begins at) and
the bits. A block can be decoded without any other, so all blocks of a file are decoded in step, one table look-up an id.

A folder of such files is ``files``, Parquet with one file in each row, and ``codebook``, its one row. Spark's own writer commits
both, so what a lost executor has half written is never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.memo import SpacedCounts

#: Ids of a block; ids after which a file ends with its document; characters that a task encodes at a time; pieces encoded at once.
BLOCK, FILE_IDS, BATCH_CHARS, TOGETHER = 512, 1 << 20, 24_000_000, 256
#: First bytes of a file, and its header: documents, ids, bits.
MAGIC, HEADER = b"QSHUFF1\n", np.dtype([("docs", "<u8"), ("ids", "<u8"), ("bits", "<u8")])
#: Of texts that don't come apart at each space and new line: runs of white space, white space at the end, and other kinds of it.
ODD = r"[ \n][ \n]|[ \n]$|[" + "".join(rf"\x{{{ord(c):x}}}" for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n") + "]"
#: What stands before the first piece of a text, and the piece that ends it; no other piece begins with two new lines.
FIRST, LAST = "\n\n", "\n\n\n"


class SpacedIds(SpacedCounts):
    """Ids of texts by their pieces, which are kept, as Arrow arrays, for pieces that come again: those that begin with a new line as
    they are, a text's first without what marks it, all others after a space.

    A space or new line before a character that isn't white space begins a token whatever stands before it, and a new line is a
    token of its own there. So pieces are encoded many at a time, with new lines between them. Punctuation after letters is encoded
    apart from them, so that a word is encoded once with all its endings."""

    #: Letters of Latin-1, and ASCII punctuation after them; an apostrophe may belong to either.
    ENDED = r"^(?P<stem>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[!-&(-/:-@\[-`{-~]+)$"

    def __init__(self, path: str, width: int = 4, end_id: int | None = None, limit: int = 2_000_000):
        super().__init__(path, limit)
        self.kind = np.dtype(f"<u{width}")
        if max(self.tokenizer.get_vocab_size(), end_id or 0) > 1 << 8 * width:
            raise ValueError(f"ids don't fit into {width} bytes")
        (self.newline,) = self.encode(["\n"])[0].ids
        self.end, self.special = [] if end_id is None else [end_id], [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.pieces, self.ids = pa.array([], pa.string()), self.lists([])

    def lists(self, ids: list[list[int]]) -> pa.ListArray:
        return pa.array(ids, pa.list_(pa.from_numpy_dtype(self.kind)))

    def each(self, words: list[str]) -> pa.ListArray:
        """Ids of each word, that has a space before it or none, no other white space, and isn't empty."""
        out, alone = [], {w for w in words if any(s in w for s in self.special)}
        plain = [w for w in words if w not in alone] if alone else words
        for e in self.encode(["\n".join(plain[i : i + TOGETHER]) for i in range(0, len(plain), TOGETHER)]):
            out += [np.array(e.ids, self.kind), np.array([self.newline], self.kind)]
        ids = np.concatenate(out[:-1]) if out else np.empty(0, self.kind)
        (cuts,) = np.nonzero(ids == self.newline)
        ends = np.append(cuts, len(ids)) - np.arange(len(cuts) + 1)
        made = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)) if plain else [0], pa.int32()), pa.array(ids[ids != self.newline]))
        if not alone:
            return made
        rest = list(alone)
        at = {w: i for i, w in enumerate([*plain, *rest])}
        return pa.concat_arrays([made, self.lists([e.ids for e in self.encode(rest)])]).take(pa.array([at[w] for w in words]))

    def made(self, pieces: pa.StringArray) -> pa.ListArray:
        """Ids of pieces that come from ``of``."""
        first = pc.starts_with(pieces, FIRST)
        line = pc.and_not(pc.starts_with(pieces, "\n"), first)
        body = pc.replace_substring_regex(pieces, r"^\n+", "")
        ended = pc.extract_regex(body, self.ENDED)
        told = lambda name, other: pc.if_else(pc.is_valid(ended), pc.struct_field(ended, name), other)
        word = pc.binary_join_element_wise(pc.if_else(pc.or_(first, line), "", " "), told("stem", body), "").dictionary_encode()
        tail = told("tail", "").dictionary_encode()
        words, tails = word.dictionary.to_pylist(), tail.dictionary.to_pylist()
        # Lists of all words, of all tails, and of nothing, a new line and the end.
        full = [w for w in words if w]
        pool = [self.each(full), self.lists([e.ids for e in self.encode(tails)]), self.lists([[], [self.newline], self.end])]
        empty = len(full) + len(tails)
        place = np.full(len(words), empty)
        place[[i for i, w in enumerate(words) if w]] = np.arange(len(full))
        lead = np.where(line.to_numpy(zero_copy_only=False), empty + 1, np.where(pc.equal(pieces, LAST).to_numpy(zero_copy_only=False), empty + 2, empty))
        index = np.stack((lead, place[word.indices.to_numpy()], len(full) + tail.indices.to_numpy()), axis=1)
        taken = pa.concat_arrays(pool).take(pa.array(index.ravel()))
        return pa.ListArray.from_arrays(pa.array(taken.offsets.to_numpy()[::3]), taken.values)

    def places(self, pieces: pa.StringArray) -> np.ndarray:
        """Where each piece stands among those known; new ones are added. ``limit`` bounds what is kept, not what is encoded."""
        found = pc.index_in(pieces, value_set=self.pieces)
        if not found.null_count:
            return found.to_numpy()
        if len(self.pieces) and len(self.pieces) + found.null_count > self.limit:
            self.forget()
            return self.places(pieces)
        new, known = pieces.filter(pc.is_null(found)), len(self.pieces)
        self.pieces, self.ids = pa.concat_arrays([self.pieces, new]), pa.concat_arrays([self.ids, self.made(new)])
        missing = pc.is_null(found).to_numpy(zero_copy_only=False)
        return np.where(missing, known + np.cumsum(missing) - 1, pc.fill_null(found, 0).to_numpy())

    def of(self, texts: pa.StringArray) -> pa.BinaryArray:
        """All ids of each text, little-endian, and the end's."""
        odd = pc.match_substring_regex(texts, ODD)
        if odd.true_count:
            apart = [np.array([*e.ids, *self.end], self.kind).tobytes() for e in self.encode(texts.filter(odd).to_pylist())]
            rest, is_odd = self.of(texts.filter(pc.invert(odd))), odd.to_numpy(zero_copy_only=False)
            where = np.where(is_odd, np.cumsum(is_odd) - 1 + len(rest), np.cumsum(~is_odd) - 1)
            return pa.concat_arrays([rest, pa.array(apart, pa.binary())]).take(pa.array(where))
        marked = pc.binary_join_element_wise(FIRST, pc.replace_substring(texts, "\n", " \n"), f" {LAST}", "")
        pieces = pc.split_pattern(marked, " ")
        told = pieces.flatten().dictionary_encode()
        places = self.places(told.dictionary)[told.indices.to_numpy()]
        each = self.ids.take(pa.array(places))
        at = each.offsets.to_numpy()[pieces.offsets.to_numpy()] * self.kind.itemsize
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(each.values.to_numpy())])


@lru_cache(maxsize=1)
def spaced_ids(path: str, width: int, end_id: int | None) -> SpacedIds:
    """One memo for all tasks that a Python worker runs."""
    return SpacedIds(path, width, end_id)


def token_ids(docs: DataFrame, tokenizer_path: str, end_id: int | None = 0, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ids (little-endian, ``width`` bytes each, ``end_id`` last) of every text; a null text is an empty one."""
    kind = dict(docs.dtypes)[id_col]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = spaced_ids(tokenizer_path, width, end_id)
        for b in batches:
            groups = np.cumsum(b.column("size").to_numpy()) // BATCH_CHARS
            cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), b.num_rows]
            for at, to in zip(cuts, cuts[1:], strict=False):
                some = b.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([some.column("id"), memo.of(some.column("text"))], ["id", "ids"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.length(text).cast("long").alias("size"))
    return rows.mapInArrow(encode, f"id {kind}, ids binary").withColumnRenamed("id", id_col)


def _joined(column: pa.BinaryArray, kind: np.dtype) -> np.ndarray:
    """The ids of all rows, one after the other."""
    if not len(column):
        return np.empty(0, kind)
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].view(kind)


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Bits of each symbol's code, ``limit`` at most, with the least total: package-merge over positive counts."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.uint8)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols have no codes of at most {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaves = np.asarray(counts, np.int64)[order]
    now, levels = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        both = np.concatenate((leaves, now[: len(now) // 2 * 2].reshape(-1, 2).sum(axis=1)))
        by_weight = np.argsort(both, kind="stable")
        now = both[by_weight]
        levels.append(by_weight < n)
    lengths, taken = np.zeros(n, np.uint8), 2 * n - 2
    for is_leaf in reversed(levels):
        own = int(is_leaf[:taken].sum())
        lengths[:own] += 1
        taken = 2 * (taken - own)
    out = np.empty(n, np.uint8)
    out[order] = lengths
    return out


class Codebook:
    """Canonical codes: shorter ones first, of one length by id."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        self.ids, self.lengths = np.asarray(ids, np.uint32), np.asarray(lengths, np.uint8)
        self.bits = int(self.lengths.max(initial=1))
        if self.bits > 24:
            raise ValueError("codes of over 24 bits can't be read at once")
        order = np.lexsort((self.ids, self.lengths))
        width = np.int64(1) << (self.bits - self.lengths[order].astype(np.int64))
        code = (np.cumsum(width) - width) >> (self.bits - self.lengths[order].astype(np.int64))
        size = int(self.ids.max(initial=0)) + 1
        self.code_of, self.length_of = np.zeros(size, np.uint64), np.zeros(size, np.uint8)
        self.code_of[self.ids[order]], self.length_of[self.ids[order]] = code, self.lengths[order]
        self.id_at, self.length_at = np.zeros(1 << self.bits, np.uint32), np.ones(1 << self.bits, np.uint8)
        self.id_at[: width.sum()], self.length_at[: width.sum()] = np.repeat(self.ids[order], width), np.repeat(self.lengths[order], width)

    @classmethod
    def of_counts(cls, ids: np.ndarray, counts: np.ndarray, max_bits: int = 16) -> Codebook:
        """``max_bits``, or more where there are more ids than it has codes for."""
        return cls(ids, code_lengths(counts, max(max_bits, int(len(ids) - 1).bit_length())))

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray, int]:
        """(bits, where each block begins, how many bits)."""
        lengths = self.length_of[ids].astype(np.int64)
        ends = np.cumsum(lengths)
        starts, total = ends - lengths, int(ends[-1]) if len(ends) else 0
        placed = self.code_of[ids] << (32 - lengths - (starts & 7)).astype(np.uint64)
        out, byte = np.zeros((total >> 3) + 5, np.uint8), starts >> 3
        # Codes don't share bits, so what falls into a byte adds up.
        for k in range((self.bits + 14) // 8):
            out += np.bincount(byte + k, ((placed >> np.uint64(24 - 8 * k)) & np.uint64(255)).astype(np.float64), len(out)).astype(np.uint8)
        return out[: (total + 7) >> 3].tobytes(), starts[::BLOCK], total

    def decode(self, bits: bytes, blocks: np.ndarray, n: int) -> np.ndarray:
        """``n`` ids of blocks that begin at ``blocks``."""
        if not n:
            return np.empty(0, np.uint32)
        raw = np.frombuffer(bits + bytes(BLOCK * self.bits // 8 + 8), np.uint8).astype(np.uint32)
        at_byte = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        at, out, mask = blocks.astype(np.int64), np.empty((BLOCK, len(blocks)), np.uint32), (1 << self.bits) - 1
        for i in range(min(BLOCK, n)):
            code = (at_byte[at >> 3] >> (32 - self.bits - (at & 7)).astype(np.uint32)) & np.uint32(mask)
            out[i] = self.id_at[code]
            at += self.length_at[code]
        return out.T.ravel()[:n]


def to_file(book: Codebook, documents: list[bytes], width: int = 4) -> bytes:
    ids = np.frombuffer(b"".join(documents), f"<u{width}")
    bits, blocks, total = book.encode(ids)
    lengths = np.array([len(d) // width for d in documents], "<u8")
    return b"".join((MAGIC, np.array([(len(documents), len(ids), total)], HEADER).tobytes(), lengths.tobytes(), blocks.astype("<u8").tobytes(), bits))


def from_file(book: Codebook, file: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids of each document, how many, all ids)."""
    if file[: len(MAGIC)] != MAGIC:
        raise ValueError("not a file of coded ids")
    (head,), at = np.frombuffer(file, HEADER, 1, len(MAGIC)), len(MAGIC) + HEADER.itemsize
    docs, n = int(head["docs"]), int(head["ids"])
    lengths = np.frombuffer(file, "<u8", docs, at).astype(np.int64)
    blocks = np.frombuffer(file, "<u8", -(-n // BLOCK), at + 8 * docs)
    return lengths, book.decode(file[at + 8 * docs + blocks.nbytes :], blocks, n)


def fit(tokens: DataFrame, width: int = 4, max_bits: int = 16, ids_col: str = "ids") -> Codebook:
    """Codes by the counts of all ids; of them one number for each id of the vocabulary comes to the driver."""
    kind_ = np.dtype(f"<u{width}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            new = np.bincount(_joined(b.column(0), kind_), minlength=len(total))
            new[: len(total)] += total
            total = new
        (there,) = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there])], ["id", "n"])

    found = tokens.where(F.length(ids_col) > 0).select(ids_col).mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").collect()
    return Codebook.of_counts(np.array([r["id"] for r in found], np.uint32), np.array([r["n"] for r in found], np.int64), max_bits)


def write_ids(tokens: DataFrame, path: str, width: int = 4, max_bits: int = 16, id_col: str = "doc_id", ids_col: str = "ids") -> None:
    """Writes a folder of files of ``tokens`` (``id_col`` and ids, little-endian, ``width`` bytes each) in ascending ``id_col``, null
    first; documents of one id stand by a hash of their ids. ``tokens`` is read three times, so it should be a table.

    Edge cases: a document without ids has none in its file, too, and comes back. Repeated rows stay. An empty table makes a folder
    that has no documents. Null ids of tokens aren't allowed; other columns are not written."""
    kind, book = dict(tokens.dtypes)[id_col], fit(tokens, width, max_bits, ids_col)
    tokens.sparkSession.createDataFrame([(bytearray(book.ids.astype("<u4").tobytes()), bytearray(book.lengths.tobytes()))], "ids binary, lengths binary").coalesce(1).write.parquet(f"{path}/codebook")
    hash_ = F.xxhash64(ids_col)
    ordered = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"), hash_.alias("hash")).repartitionByRange("id", "hash").sortWithinPartitions("id", "hash")

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, held, size, number = TaskContext.get().partitionId(), 0, [], 0, 0

        def closed() -> pa.RecordBatch:
            whole = [pa.array([v], t) for v, t in ((part, pa.int32()), (number, pa.int32()), (before, pa.int64()), (size, pa.int64()))]
            return pa.RecordBatch.from_arrays([*whole, pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), pa.concat_arrays([i for i, _ in held])), pa.array([to_file(book, [d for _, d in held], width)], pa.binary())], ["part", "number", "before", "n", "documents", "file"])

        for b in batches:
            for i, ids in enumerate(b.column("ids").to_pylist()):
                held.append((b.column("id").slice(i, 1), ids))
                size += len(ids) // width
                if size >= FILE_IDS:
                    yield closed()
                    before, held, size, number = before + size, [], 0, number + 1
        if held:
            yield closed()

    ordered.mapInArrow(files, f"part int, number int, before long, n long, documents array<{kind}>, file binary").write.option("compression", "uncompressed").parquet(f"{path}/files")


def read_codebook(spark: SparkSession, path: str) -> Codebook:
    row = spark.read.parquet(f"{path}/codebook").first()
    return Codebook(np.frombuffer(bytes(row["ids"]), "<u4"), np.frombuffer(bytes(row["lengths"]), np.uint8))


def read_ids(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, start (ids of all documents before it), n_tokens and ids (little-endian 32-bit) of every document in a folder of files."""
    stored, book = spark.read.parquet(f"{path}/files"), read_codebook(spark, path)
    kind = dict(stored.dtypes)["documents"][6:-1]
    # One number for each task that wrote.
    parts = stored.groupBy("part").agg(F.sum("n").alias("n"))
    first = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                lengths, ids = from_file(book, b.column("file")[i].as_py())
                ends, raw = np.cumsum(lengths), ids.astype("<u4").tobytes()
                starts = ends - lengths
                each = pa.array([raw[4 * a : 4 * e] for a, e in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("documents")[i].values, pa.array(starts + b.column("at")[i].as_py()), pa.array(lengths), each], ["id", "start", "n_tokens", "ids"])

    rows = stored.join(F.broadcast(first), "part").select("documents", "file", (F.col("first") + F.col("before")).alias("at"))
    return rows.mapInArrow(documents, f"id {kind}, start long, n_tokens long, ids binary").withColumnRenamed("id", id_col)
