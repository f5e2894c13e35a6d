"""Chunk rows of whole tables and of odd texts against loops over one text at a time."""

import random

import plain_chunks
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import chunkset
from quillspark.operators.chunk import ChunkOptions, chunk_batch, chunk_documents
from quillspark.plans import catalogue


def odd_texts(n=400, seed=5):
    """Texts of lines of all kinds in any order, so that headers, lists and blank lines meet as they never do in real ones."""
    rng = random.Random(seed)
    words = "the party shall pay Rent on time (see below) and ÉTÉ 4.2 euros".split()
    say = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) + rng.choice([".", "!", "", ' "x." And', ". Then"])
    lines = [
        say, say, say, lambda: "", lambda: "  \u00a0 ", lambda: f"{rng.randrange(4)}. {rng.choice(['TERMS OF USE', 'Scope', 'Ab'])}", lambda: f"{rng.randrange(4)}.{rng.randrange(4)}. Point {say()}", lambda: f"{rng.randrange(3)}.1 Title",
        lambda: f"Article {rng.randrange(9)} - Matter", lambda: f"Section {rng.randrange(9)} § 3 {say()}", lambda: f"({rng.randrange(9)}) {say()}", lambda: f"({rng.choice('abciv')}) {say()}", lambda: f"Clause {rng.randrange(9)} {say()}", lambda: f"Para. 3 {say()}",
        lambda: f"• {say()}", lambda: f"- {say()}", lambda: "PART " + rng.choice("ABC"), lambda: f"a. {say()}", lambda: "\u3000" + say() + "\u0001", lambda: "§1 §2 §3",
    ]
    out = ["", "\n\n", "\u00a0", "1. ALPHA BETA\n2. GAMMA\n3. DELTA"]
    for _ in range(n):
        chosen = rng.sample(lines, rng.randrange(2, 7))
        out.append("\n" * rng.randrange(2) + "\n".join(rng.choice(chosen)() for _ in range(rng.randrange(1, 30))))
    return out


def same(got, texts, mode, **options):
    """All rows of (doc_id, ordinal, ...) against the loops."""
    by = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.ordinal)):
        by.setdefault(r.doc_id, []).append([r.content, r.chunk_id, list(r.hierarchy), r.start_pos, r.end_pos])
    kinds = {r.doc_id: r.doc_type for r in got}
    for i, text in texts.items():
        want = plain_chunks.chunks(text, mode, **options)
        assert by.get(i, []) == want, (i, plain_chunks.kind_of(text), text[:300])
        assert i not in kinds or kinds[i] == plain_chunks.kind_of(text)


@pytest.mark.parametrize("mode", ["observed", "documented"])
def test_whole_table(spark, sf_dir, mode):
    docs = catalogue._made_whole(catalogue._read(spark, sf_dir, "documents"))
    same(chunk_documents(docs, options=ChunkOptions(semantics=mode)).collect(), {r.doc_id: r.text for r in docs.collect()}, mode)


@pytest.mark.parametrize("mode", ["observed", "documented"])
@pytest.mark.parametrize("most", [None, 300])
def test_odd_texts(spark, mode, most):
    texts = dict(enumerate(odd_texts()))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    kinds = {plain_chunks.kind_of(t) for t in texts.values()}
    assert len(kinds) == 4
    same(chunk_documents(docs, options=ChunkOptions(semantics=mode, max_chunk_size=most)).collect(), texts, mode, **({"most": most} if most else {}))


def test_very_many_sections_and_lines(spark):
    n = 20_000
    body = "The parties agree to all that is said here and to nothing else. "
    texts = {0: "\n" + "\n".join(f"{i}. TERMS OF {body}" for i in range(1, n)), 1: "\n".join(f"Article {i} - {body}" for i in range(1, n)), 2: "\n".join(f"({'abcdefgh'[i % 8]}) {body}" for i in range(n)), 3: "\n\n".join(body + body for _ in range(n))}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4, "doc_id")
    same(chunk_documents(docs, options=ChunkOptions(semantics="documented")).collect(), texts, "documented")


def test_white_space_is_that_of_unicode(spark):
    lines = ["\u00a0one\u3000", "\u2003\u00a0", "\u0001kept\u0001", "\x1ctwo\u0085", "a\u00a0b\u3000c\u0001d"]
    row = spark.createDataFrame([("\n".join(lines),)], "t string").select(T.clean_text(F.col("t")).alias("c"), T.word_count(F.col("t")).alias("n"), T.sentences(F.lit("One.\u00a0Two\u0001x. Three"), "documented").alias("s")).first()
    assert row.c == "one\n\u0001kept\u0001\ntwo\na\u00a0b\u3000c\u0001d"
    assert row.n == len(" ".join(lines).split()) and row.s == ["One.", "Two\u0001x.", "Three"]


def test_statistics_and_documents_exported_equal_loops(spark, sf_dir):
    docs = catalogue._made_whole(catalogue._read(spark, sf_dir, "documents"))
    made = chunk_documents(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = {i: plain_chunks.chunks(t) for i, t in texts.items()}
    for r in chunkset.statistics(docs, made).collect():
        sizes = [len(c[0]) for c in want[r.doc_id]] or [0]
        depths = [len(c[2]) for c in want[r.doc_id]] or [0]
        assert (r.total_chunks, r.total_characters, r.min_chunk_size, r.max_chunk_size, r.max_hierarchy_depth, r.original_size) == (len(want[r.doc_id]), sum(sizes), min(sizes), max(sizes), max(depths), len(texts[r.doc_id]))
        assert r.avg_chunk_size == pytest.approx(sum(sizes) / len(sizes)) and sum(t.n for t in r.chunk_types) == r.total_chunks
    title = lambda c, i: f"{'#' * min(len(c[2]), 6)} {c[2][-1]}" if c[2] else f"## Chunk {i + 1}"
    markdown = {r.doc_id: r.body for r in chunkset.export_documents(made, "markdown").collect()}
    assert markdown == {i: "\n\n---\n\n".join(f"{title(c, j)}\n\n{c[0]}" for j, c in enumerate(cs)) for i, cs in want.items() if cs}
    import csv
    import io
    import json

    for r in chunkset.export_documents(made, "json").collect():
        assert [[x["content"], x["id"], x["hierarchy"], x["start_pos"], x["end_pos"]] for x in json.loads(r.body)] == want[r.doc_id]
    for r in chunkset.export_documents(made, "csv").collect():
        head, *rows = csv.reader(io.StringIO(r.body), escapechar="\\")
        assert head == ["chunk_id", "content", "hierarchy", "start_pos", "end_pos"]
        assert [x[0] for x in rows] == [c[1] for c in want[r.doc_id]] and [x[2] for x in rows] == [" > ".join(c[2]) for c in want[r.doc_id]]


def test_batch_says_why_there_are_no_chunks(spark):
    df = spark.createDataFrame([(1, "some text"), (2, None), (3, "1. ONE PART\nshort\n2. TWO PART\nshort\n3. END PART"), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in chunk_batch(df).collect()}
    assert len(got) == 4 and len(got[1].chunks) == 1 and got[1].error is None
    assert got[2].error == "no text" and got[3].error is None and got[3].warning and got[4].warning and not got[3].chunks
