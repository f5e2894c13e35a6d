"""Layout of web pages, and chunks by it, against loops."""

import random
import re
from html import unescape

import pandas as pd
import plain_chunks
import pytest
from pyspark.sql import functions as F

from quillspark.operators.chunk import ChunkOptions, chunk_documents, layout_chunks
from quillspark.operators.detect import DetectOptions
from quillspark.plans import catalogue
from quillspark.sources import html


def rows(got):
    return [[c.content, c.chunk_id, list(c.hierarchy), c.start_pos, c.end_pos] for c in got]


def plain_blocks(page):
    """Texts of blocks by cutting at tags."""
    page = re.sub(r"(?s)<!--.*?-->|<!DOCTYPE[^>]*>", "", page)
    page = re.sub(r"(?s)<(script|style|title)\b.*?</\1>", "", page)
    out, bold, size, parts, tag = [], False, 10.0, [], ""

    def closed():
        text = "\n".join(x for line in "".join(t for t, _ in parts).split("\n") if (x := " ".join(line.split())))
        if text:
            out.append({"text": text, "font_size": size, "is_bold": size == 20.0 or all(b for t, b in parts if t.strip()), "is_centered": False})
        parts.clear()

    for piece in re.split(r"(<[^>]*>)", page):
        if not piece.startswith("<"):
            text = unescape(piece.replace("\n", " "))
            parts.append((text, bold))
            continue
        tag = re.match(r"</?([a-z0-9]*)", piece)[1]
        if tag == "br":
            parts.append(("\n", True))
        elif tag == "b":
            bold = not piece.startswith("</")
        elif tag in html.BLOCKS:
            closed()
            bold, size = False, 20.0 if piece.startswith("<h1") else 10.0
    closed()
    return out


def test_pages_of_the_table(spark, sf_dir):
    got = {}
    for r in catalogue.queries()["layout_pages"](spark, sf_dir).orderBy("page_id", "ordinal").collect():
        got.setdefault(r.page_id, []).append((r.doc_type, r.content, r.chunk_id, r.path, r.start_pos, r.end_pos))
    seen = 0
    for page in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        blocks = plain_blocks(page.html)
        assert [b["text"] for b in html.scan(page.html)["layout"]["blocks"]] == [b["text"] for b in blocks]
        if plain_chunks.kind_of("\n".join(b["text"] for b in blocks)) != "unstructured":
            continue
        want = plain_chunks.layout("\n".join(b["text"] for b in blocks), blocks, 10.0, "observed")
        assert got.get(page.page_id, []) == [("layout_based", c[0], c[1], " > ".join(c[2]), c[3], c[4]) for c in want]
        seen += 1
    assert seen > 20


def test_scanner():
    page = """<html><head><title>no</title><script>if (a < b) "</p>"</script></head><body><!-- <h1>no</h1> --><h1>One &amp; <i>all</i></h1>
    <p>First<br>line <b>bold</b><p><b>All bold</b> <strong>here</strong><p>plain</b> again<div style="TEXT-ALIGN: center">mid</div><center>so</center>
    <table><tr><th>head<td>cell</table><h3>Three<p>end"""
    seen = html.scan(page)
    assert [(b["text"], b["font_size"], b["is_bold"], b["is_centered"]) for b in seen["layout"]["blocks"]] == [
        ("One & all", 20.0, True, False), ("First\nline bold", 10.0, False, False), ("All bold here", 10.0, True, False), ("plain again", 10.0, False, False),
        ("mid", 10.0, False, True), ("so", 10.0, False, True), ("head", 10.0, True, False), ("cell", 10.0, False, False), ("Three", 11.7, True, False), ("end", 10.0, False, False),
    ]
    assert seen["layout"]["headings"] == [{"level": 1, "text": "One & all"}, {"level": 3, "text": "Three"}] and seen["text"].startswith("One & all\nFirst\nline bold\n")
    for odd in (None, "", "no tags", "<", "<p", "</p></b>", "<!--", "&#x;&bogus;", "<b><b><p></b>x"):
        assert set(html.scan(odd)) == {"text", "layout"}
    assert html.scan(None)["layout"]["blocks"] == [] and html.scan("<b><b><p></b>x")["text"] == "x"


def made(seed, n):
    rng = random.Random(seed)
    heads = ["Scope", "Terms of use", "Scope", "Part  two", "x" * 201, " ", "Not in the text"]
    out = []
    for _ in range(n):
        blocks, lines = [], []
        for _ in range(rng.randrange(0, 9)):
            text = rng.choice(heads) if rng.random() < 0.6 else " ".join(rng.choice(["Rent", "due", "Scope", "notice.", "and"]) for _ in range(rng.randrange(1, 500)))
            blocks.append({"text": rng.choice([text, text, None]) if rng.random() < 0.1 else text, "font_size": rng.choice([None, 9.0, 10.0, 12.0, 13.0, 15.0, 20.0]), "is_bold": rng.choice([True, False, None]), "is_centered": rng.random() < 0.1})
            lines += [text] if text != "Not in the text" else []
            lines += [""] * rng.randrange(2)
        out.append(("\n".join(lines), blocks))
    return [*out, ("", []), ("text without blocks " * 200, []), ("A head\n\nsome text\n\n" * 90, [{"text": "none", "font_size": 10.0, "is_bold": None, "is_centered": None}])]


@pytest.mark.parametrize("mode", ["observed", "documented"])
def test_layout_chunks_equal_loops(spark, mode):
    docs = made(8, 120)
    kind = "struct<headings:array<struct<level:int>>,blocks:array<struct<text:string,font_size:double,is_bold:boolean,is_centered:boolean>>,base_font_size:double>"
    df = spark.createDataFrame([(i, t, ([], [tuple(b.values()) for b in blocks], 10.0)) for i, (t, blocks) in enumerate(docs)], f"i int, text string, layout {kind}")
    got = {r.i: rows(r.c) for r in df.select("i", layout_chunks(F.col("text"), F.col("layout"), ChunkOptions(semantics=mode)).alias("c")).collect()}
    several = 0
    for i, (text, blocks) in enumerate(docs):
        want = plain_chunks.layout(text, blocks, 10.0, mode)
        assert got[i] == want, (i, text[:200])
        several += len(want) > 1
    assert several > 25  # so that hierarchies are compared


def test_sections_end_at_headers_where_the_search_begins(spark):
    texts = [
        "1. ABCDEF 2. Next goes on in the same line and is long enough to be a chunk of its own.\n3. THIRD ONE\nwith a text that is long enough to be a chunk.\n4. FOURTH\nand more of it.",
        "1.1. Abcde 1.2. Same level in the line, after ten characters, and long enough for a chunk.\n2. ALPHA BETA\n3. GAMMA\n4. DELTA EPS\n",
        "1. ALPHA BETA\nA text that is long enough to be a chunk of its own, so that it counts.\n2. B\nwhat stands below a capital alone belongs to no section, however long it is.\n3. GAMMA DEL\n4. DELTA EPS",
        "2. AB 3. CDEF 4. Gh\n5. ALPHA\n6. BETA GAMMA and so on, which is long enough to be a chunk of its own, at last.\n7. DELTA",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for mode in ("observed", "documented"):
        got = {}
        for r in chunk_documents(df, options=ChunkOptions(semantics=mode), detect_options=DetectOptions(numbered_least=1)).orderBy("doc_id", "ordinal").collect():
            got.setdefault(r.doc_id, []).append([r.content, r.chunk_id, list(r.hierarchy), r.start_pos, r.end_pos])
        for i, text in enumerate(texts):
            assert got.get(i, []) == plain_chunks.numbered(text, mode), (i, mode)
    assert plain_chunks.numbered(texts[0], "observed")[0][2] != ["1. ABCDEF 2. Next"] and plain_chunks.ENDING.search(texts[0][10:]).start() == 0


def test_a_batch_is_scanned_a_few_pages_at_a_time(spark):
    """No more than AT_A_TIME pages have their blocks in memory at once, and each page keeps its own row."""
    pages = pd.Series([None if i % 7 == 3 else f"<h1>t{i}</h1><p>b{i}</p>" for i in range(html.AT_A_TIME * 2 + 5)])
    parts = list(html.scanned(pages))
    assert [len(p) for p in parts] == [html.AT_A_TIME, html.AT_A_TIME, 5] and not list(html.scanned(pages[:0]))
    frame = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "id long, html string").coalesce(1)
    got = {r.id: r.text for r in frame.select("id", html.layout_of(F.col("html")).alias("s")).select("id", "s.text").collect()}
    assert got == {i: html.scan(p)["text"] for i, p in enumerate(pages)}
