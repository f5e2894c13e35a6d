"""Files of coded ids: code lengths against exhaustive search, files and queries against the tokenizer itself."""

import heapq
import itertools
import zlib

import cases
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import huffman, queries
from quillspark.llm.common import new_folder


def encode(memo, text):
    return memo.tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def memo():
    return huffman.SpacedIds(queries.tokenizer_path("byte_bpe_50k.json"))


def plain_huffman(counts):
    heap = [(c, i, 0) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    total, n = 0, len(counts)
    while len(heap) > 1:
        (a, *_), (b, *_) = heapq.heappop(heap), heapq.heappop(heap)
        total, n = total + a + b, n + 1
        heapq.heappush(heap, (a + b, n, 0))
    return total


@given(st.lists(st.integers(1, 1000), min_size=2, max_size=60))
def test_unlimited_lengths_are_huffmans(counts):
    lengths = huffman.code_lengths(np.array(counts), 60).astype(int)
    assert int((lengths * counts).sum()) == plain_huffman(counts)
    assert sum(2.0**-x for x in lengths.tolist()) == 1


@settings(deadline=None, max_examples=40)
@given(st.lists(st.integers(1, 300), min_size=2, max_size=6))
def test_limited_lengths_are_the_best(counts):
    limit = 3
    best = min(sum(c * x for c, x in zip(counts, p, strict=True)) for p in itertools.product(range(1, limit + 1), repeat=len(counts)) if sum(2.0**-x for x in p) <= 1)
    lengths = huffman.code_lengths(np.array(counts), limit).astype(int)
    assert lengths.max() <= limit and sum(2.0**-x for x in lengths.tolist()) <= 1 and int((lengths * counts).sum()) == best


def test_codes_are_canonical_and_prefix_free():
    book = huffman.Codebook.of_counts(np.array([7, 3, 900_000, 5]), np.array([1, 10, 3, 1]))
    codes = [format(int(book.code_of[i]), f"0{book.length_of[i]}b") for i in (3, 900_000, 5, 7)]
    assert codes == ["0", "10", "110", "111"]
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9), 3)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 2000), max_size=3000), st.integers(1, 14))
def test_round_trip_of_a_file(ids, pieces):
    ids = np.array(ids, np.uint32)
    there, counts = np.unique(ids, return_counts=True)
    book = huffman.Codebook.of_counts(there, counts, 12)
    docs = [d.astype("<u4").tobytes() for d in np.array_split(ids, pieces)]
    lengths, back = huffman.from_file(book, huffman.to_file(book, docs))
    assert lengths.tolist() == [len(d) // 4 for d in docs] and (back == ids).all()


def test_each_block_stands_alone():
    ids = np.random.default_rng(2).geometric(0.02, 10_000).astype(np.uint32)
    there, counts = np.unique(ids, return_counts=True)
    book = huffman.Codebook.of_counts(there, counts)
    bits, blocks, _ = book.encode(ids)
    assert len(blocks) == -(-10_000 // huffman.BLOCK)
    for k in (0, 3, len(blocks) - 1):
        want = ids[k * huffman.BLOCK : (k + 1) * huffman.BLOCK]
        assert (book.decode(bits, blocks[k : k + 1], len(want)) == want).all()
    with pytest.raises(ValueError):
        huffman.from_file(book, b"other bytes than those of a file")


ODD = ["", "\n", "a\n", " a", "a  b\n\n c\td", "a　 b\n\x85c <|endoftext|> x\n<|endoftext|>\ny", "x\n y", "é\nà don't 's  ", "\n\nq", " \n \n z", "a\nb\nc d e.", "it's, 'tis. x×y. ok", " a b", "1,2 3.", "\x1c a \x1cb"]


def test_ids_of_pieces_are_ids_of_texts(memo):
    for text in ODD:
        assert np.frombuffer(memo.of(pa.array([text]))[0].as_py(), "<u4").tolist() == encode(memo, text), text


@settings(deadline=None, max_examples=150)
@given(st.lists(st.sampled_from([*"ab'sZé1    .,\n\n\t　<|>-", "word", "<|endoftext|>"]), max_size=40).map("".join))
def test_ids_of_any_text(memo, text):
    assert np.frombuffer(memo.of(pa.array([text]))[0].as_py(), "<u4").tolist() == encode(memo, text)


def test_odd_texts_keep_their_place():
    memo = huffman.SpacedIds(queries.tokenizer_path("byte_bpe_50k.json"), 2, 7)
    texts = [t for x in zip(ODD, ["plain text, of words.", "x", "two\nlines"] * 9, strict=False) for t in x]
    assert [np.frombuffer(i, "<u2").tolist() for i in memo.of(pa.array(texts)).to_pylist()] == [[*encode(memo, t), 7] for t in texts]
    with pytest.raises(ValueError):
        huffman.SpacedIds(queries.tokenizer_path("byte_bpe_50k.json"), 1)


def test_query_equals_the_tokenizer(spark, sf_dir, memo):
    rows = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    got, start = {r.doc_id: r for r in queries.op12_token_files(spark, sf_dir).collect()}, 0
    assert len(got) == len(rows)
    for i, text in rows:
        ids = [*encode(memo, text), 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_odd_rows_in_several_files(spark, docs, empty, memo, monkeypatch):
    monkeypatch.setattr(huffman, "FILE_IDS", 50)
    folder = new_folder(spark)
    huffman.write_ids(huffman.token_ids(docs, queries.tokenizer_path("byte_bpe_50k.json")), folder)
    stored = spark.read.parquet(f"{folder}/files")
    back = huffman.read_ids(spark, folder).collect()
    want = sorted((r.doc_id is not None, r.doc_id or 0, tuple([*encode(memo, r.text), 0])) for r in docs.collect())
    assert sorted((r.doc_id is not None, r.doc_id or 0, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in back) == want
    at = 0
    for r in sorted(back, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id if r.doc_id is not None else -1 for r in sorted(back, key=lambda r: r.start)]
    assert ids == sorted(ids) and len(back) == len(cases.TEXTS) + 3 and stored.count() > 1
    folder = new_folder(spark)
    huffman.write_ids(huffman.token_ids(empty, queries.tokenizer_path("byte_bpe_50k.json")), folder)
    assert huffman.read_ids(spark, folder).count() == 0
