"""Token counts and packing against the tokenizers themselves."""

import zlib
from collections import defaultdict, namedtuple

import cases
import numpy as np
import pytest

from quillspark.llm.memo import SpacedCounts, WordIds
from quillspark.llm.packing import CLASSES, PADDING, Packer, cut, pack_documents
from quillspark.llm.queries import tokenizer_path
from quillspark.llm.token_counts import count_tokens

pytest.importorskip("public_tokenizers")
BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
ODD = ["<|endoftext|> in a text", "x" * 5000, "a  b   c\n\n d e　f", "don't   can't ' s", "   lead", "\u0001 mark \u0001x", "End. Stop, go.,.. a.b,c É. é,", "<|StartOfText|> <|ENDOFTEXT|> x", "İstanbul ǅ ß", "日本語のテキスト。 한국어"]


def encode(path, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(cases.TEXTS + ODD)), "doc_id long, text string")


@pytest.mark.parametrize(("chunk", "overlap"), [(1 << 16, 512), (200, 8)])
def test_counts_equal_the_tokenizer(texts, chunk, overlap):
    got = {r.doc_id: r for r in count_tokens(texts, BYTE, chunk_chars=chunk, overlap_chars=overlap, widen=3).collect()}
    assert len(got) == len(cases.TEXTS + ODD)
    for i, t in enumerate(cases.TEXTS + ODD):
        assert (got[i].n_bytes, got[i].n_tokens) == (len((t or "").encode()), len(encode(BYTE, t or ""))), t and t[:40]


def test_counts_of_edge_rows(docs, empty):
    got = count_tokens(docs, BYTE).collect()
    assert len(got) == docs.count() and sum(r.doc_id is None for r in got) == 2
    assert count_tokens(empty, BYTE).count() == 0


def check_packed(rows, wanted, capacity=4096):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, ids in wanted.items():
        at = 0
        for p in sorted(pieces[i], key=lambda r: r.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.length > 0
            assert zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes()) == p.ids_crc32
            at += p.length
        assert at == len(ids)
    padding = 0
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def test_packing_keeps_every_id(texts):
    wanted = {i: [*encode(WORD, t or ""), 2] for i, t in enumerate(cases.TEXTS + ODD)}
    padding = check_packed(pack_documents(texts, WORD).collect(), wanted)
    assert padding <= 0.02 * sum(map(len, wanted.values()))


def test_packing_of_edge_rows(docs, empty):
    rows = pack_documents(docs, WORD).collect()
    assert sum(r.length for r in rows if r.start == 0 or True) == sum(r.doc_tokens for r in rows if r.start == 0)
    assert pack_documents(empty, WORD).count() == 0


def test_cut_pieces_fit_their_class():
    for n in (1, 63, 64, 100, 256, 257, 1000, 3000, 4000, 4095, 4096, 4097, 10_000):
        parts = cut(n, 4096)
        assert sum(parts) == n and all(p > 0 for p in parts)
        large = [p for p in parts if p * CLASSES > 4096]
        assert sum(4096 / (4096 // p) - p for p in large) <= PADDING * n + len(large)
    assert cut(2040, 4096) == [2040] and cut(3000, 4096) == [2048, 819, 133]


@pytest.mark.parametrize("lengths", [[3000] * 40, [17] * 3000, list(range(1, 900)), [4096, 5000, 1, 2047], [1], []])
def test_bins_hold_what_their_class_says(lengths):
    packer, out = Packer(4096, 7), []
    for i, n in enumerate(lengths):
        out += packer.add((i, n), np.full(n, i, "<u4").tobytes())
    out += packer.finish()
    Row = namedtuple("Row", "doc_id doc_tokens start length ids_crc32 sequence_id offset")
    rows = [Row(*row, start, length, crc, seq, offset) for row, start, length, crc, seq, offset in out]
    padding = check_packed(rows, {i: [i] * n for i, n in enumerate(lengths)})
    assert padding <= PADDING * sum(lengths) + 15 * len(lengths) / 10
    assert all(r.sequence_id >= 7 for r in rows)


def test_only_known_kinds_of_tokenizer_are_taken():
    with pytest.raises(ValueError, match="byte-level"):
        SpacedCounts(WORD)
    with pytest.raises(ValueError, match="white space"):
        WordIds(BYTE)


def test_texts_without_a_boundary_widen_until_whole(spark):
    texts = ["x" * 900, "ab" * 700 + " tail of it", "one word " + "y" * 1500 + " and more words", " " * 1200 + "end"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in count_tokens(frame, BYTE, chunk_chars=256, overlap_chars=8, widen=4).collect()}
    assert got == {i: len(encode(BYTE, t)) for i, t in enumerate(texts)}
