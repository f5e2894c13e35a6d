"""Files read by ranges of bytes against whole files cut at form feeds."""

import io
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.sources import paged


def test_a_large_file_is_read_by_several_tasks(spark, tmp_path):
    rng = random.Random(1)
    pages = [" ".join(rng.choice(["rent", "dûe", "☃", "naïve"]) for _ in range(rng.randrange(12))) for _ in range(10_000)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "large.txt").write_text("\x0c".join(pages), newline="")
    (tmp_path / "in" / "small.txt").write_text("one page")
    (tmp_path / "in" / "none.txt").write_bytes(b"")
    (tmp_path / "in" / "latin.txt").write_bytes("caf\xe9".encode("latin-1") + b"\x0c" + "é".encode())
    (tmp_path / "in" / "_hidden").write_text("no")
    df = paged.read_pages(spark, str(tmp_path / "in"), 20_000)
    got = {}
    for r in df.orderBy("path", "page_number").collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.page_number, r.text))
    assert got["large.txt"] == list(enumerate(pages, 1))
    assert got["small.txt"] == [(1, "one page")] and got["none.txt"] == [(1, "")] and got["latin.txt"] == [(1, "café"), (2, "é")] and len(got) == 4
    spark.dataSource.register(paged.PagedText)
    raw = spark.read.format("quill_pages").option("rangeBytes", 20_000).load(str(tmp_path / "in" / "large.txt"))
    assert raw.rdd.getNumPartitions() > 10 and raw.select("range").distinct().count() > 10
    with pytest.raises(Exception, match="a byte at least"):
        spark.read.format("quill_pages").option("rangeBytes", 0).load(str(tmp_path / "in")).count()


@settings(deadline=None, max_examples=300)
@given(st.text(st.sampled_from("ab\x0c\x0cé"), max_size=40), st.integers(1, 12), st.integers(1, 7))
def test_ranges_share_pages_out(text, size, block):
    raw = text.encode()
    old, paged.READ_BYTES = paged.READ_BYTES, block
    try:
        got = [p for at in range(0, len(raw) + 1, size) for p in paged.pages_of(pa.PythonFile(io.BytesIO(raw), "r"), at, at + size)]
    finally:
        paged.READ_BYTES = old
    want, at = [], 0
    for page in raw.split(b"\x0c"):
        want.append((at, page))
        at += len(page) + 1
    assert got == want
