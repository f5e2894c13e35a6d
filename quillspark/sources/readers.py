"""Readers: files in, one row a document out, with its pages. A reader never fails a job: errors are columns.

Text is read by Spark expressions, DOCX with the standard library in ``mapInPandas``. PDF and images need an OCR or text
provider, which can be registered; without one their rows say so.
"""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import let, pack, paragraphs, strip, word_count

PAGE_SIZE, NATIVE_LEAST = 3000, 30
PAGE = "struct<page_number:int,text:string,page_type:string,confidence:double,error:string>"
PARSED = f"path string, pages array<{PAGE}>, metadata map<string,string>, errors array<string>"
# Which extensions there are readers for.
TEXT, DOCX, PDF, IMAGE = ("txt", "md", "rst", "text"), ("docx", "doc"), ("pdf",), ("jpg", "jpeg", "png", "tiff", "tif", "bmp", "webp")
HEADINGS = ("heading 1", "heading 2", "heading 3", "heading 4", "title", "subtitle")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: bytes -> (pages as (text, kind, confidence), metadata)
Provider = Callable[[bytes], tuple[list[tuple[str, str, float | None]], dict[str, str]]]


class Readers:
    def __init__(self):
        self.by_extension: dict[str, Provider] = dict.fromkeys(DOCX[:1], read_docx)

    def register(self, *extensions: str):
        def put(provider: Provider) -> Provider:
            self.by_extension |= {e.lower().lstrip("."): provider for e in extensions}
            return provider

        return put

    def supported(self) -> list[str]:
        return sorted({*TEXT, *DOCX, *PDF, *IMAGE, *self.by_extension})


def split_pages(text: Column, size: int = PAGE_SIZE) -> Column:
    """Paragraphs packed into pages of about ``size`` characters, separators not counted; one empty page for no text."""
    pages = pack(paragraphs(text), size, count_joiners=False)
    return F.when(F.size(pages) == 0, F.array(F.lit(""))).otherwise(pages)


def page_decision(native: Column, ocr: Column, least: int = NATIVE_LEAST) -> Column:
    """Struct of text and page_type: native text if long enough, else OCR, called hybrid where it more than doubles some native text."""
    own, seen = F.coalesce(strip(native), F.lit("")), F.coalesce(strip(ocr), F.lit(""))
    kind = F.when(F.length(own) >= least, "native_text").when((F.length(own) > 0) & (F.length(seen) > 2 * F.length(own)), "hybrid").otherwise("ocr")
    return F.struct(F.when(kind == "native_text", own).otherwise(seen).alias("text"), kind.alias("page_type"))


def ocr_confidence(values: Column) -> Column:
    """Mean of the confidences that aren't negative, to one place."""
    good = F.filter(values, lambda c: c >= 0)
    return F.round(F.try_divide(F.aggregate(good, F.lit(0.0), lambda s, c: s + c), F.size(good)), 1)


def ingest_status(n_pages: Column, n_errors: Column) -> Column:
    return F.when(n_pages == 0, "failed").when((n_errors > 0) & (n_errors < n_pages), "partial").when(n_errors > 0, "failed").otherwise("success")


def plain_text(pages: Column, markers: bool = False) -> Column:
    """Pages that aren't blank, in order, with or without their numbers before them."""
    full = F.filter(F.array_sort(pages), lambda p: strip(p["text"]) != "")
    return F.array_join(F.transform(full, lambda p: F.concat(F.lit("[PAGE "), p["page_number"].cast("string"), F.lit("]\n"), strip(p["text"])) if markers else strip(p["text"])), "\n\n")


def page_summary(pages: Column) -> Column:
    of = lambda kind: F.size(F.filter(pages, lambda p: p["page_type"] == kind))
    known = F.filter(F.transform(pages, lambda p: p["confidence"]), lambda c: c.isNotNull())
    words = F.aggregate(pages, F.lit(0), lambda s, p: s + word_count(p["text"]))
    chars = F.aggregate(pages, F.lit(0), lambda s, p: s + F.length(p["text"]))
    mean = F.round(F.try_divide(F.aggregate(known, F.lit(0.0), lambda s, c: s + c), F.size(known)), 1)
    return F.struct(F.size(pages).alias("total_pages"), chars.alias("char_count"), words.alias("word_count"), of("native_text").alias("native_pages"), of("ocr").alias("ocr_pages"), mean.alias("avg_ocr_confidence"))


def summary_text(path: Column, status: Column, pages: Column, errors: Column) -> Column:
    """A document's result in lines: file, status, pages by kind, characters, words, mean confidence and errors."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"))
    of = lambda p: F.concat_ws("\n", line("File", path), line("Status", status), line("Pages", p["total_pages"]), line("Native", p["native_pages"]), line("OCR", p["ocr_pages"]), line("Characters", p["char_count"]), line("Words", p["word_count"]), line("OCR confidence", p["avg_ocr_confidence"]), F.when(F.size(errors) > 0, line("Errors", F.array_join(errors, "; "))))
    return let(page_summary(pages), of)


def to_json(results: DataFrame) -> DataFrame:
    """One JSON object a row, of all columns, nulls too."""
    return results.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def table_text(cells: Column) -> Column:
    """Rows of an array of arrays, cells by `` | ``."""
    cell = lambda c: strip(F.replace(c, F.lit("\n"), F.lit(" ")))
    return F.array_join(F.transform(cells, lambda r: F.array_join(F.transform(r, cell), " | ")), "\n")


def read_docx(content: bytes) -> tuple[list[tuple[str, str, float | None]], dict[str, str]]:
    """A page for each heading with what stands below it; tables as lines of cells."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        core = ET.fromstring(z.read("docProps/core.xml")) if "docProps/core.xml" in z.namelist() else []
    text_of = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()
    sections: list[tuple[str, list[str]]] = [("", [])]
    for e in body:
        if e.tag == f"{_W}tbl":
            rows = [" | ".join(text_of(c).replace("\n", " ") for c in r.iter(f"{_W}tc")) for r in e.iter(f"{_W}tr")]
            sections[-1][1].append("\n".join(rows))
        elif e.tag == f"{_W}p" and (text := text_of(e)):
            style = e.find(f"{_W}pPr/{_W}pStyle")
            name = (style.get(f"{_W}val", "") if style is not None else "").lower().replace("heading", "heading ").replace("  ", " ").strip()
            if name in HEADINGS:
                sections.append((text, []))
            else:
                sections[-1][1].append(text)
    pages = ["\n\n".join(filter(None, (head, "\n".join(lines)))) for head, lines in sections if head or lines]
    return [(p, "native_text", None) for p in pages], {e.tag.split("}")[-1]: e.text for e in core if e.text}


def read_documents(spark: SparkSession, path: str, readers: Readers | None = None) -> DataFrame:
    """path, file_type, pages, metadata, errors, status of every file below ``path`` (a file, folder or pattern)."""
    return parse_files(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path), readers)


def parse_files(files: DataFrame, readers: Readers | None = None) -> DataFrame:
    """The same of (path, content) rows, such as a batch of a stream holds."""
    readers = readers or Readers()
    files = files.select("path", "content")
    files = files.withColumn("file_type", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    # UTF-8 where it is valid, else Latin-1, in which all bytes are.
    valid = F.expr("try_validate_utf8(cast(content as string))")
    raw = F.regexp_replace(F.coalesce(valid, F.decode("content", "ISO-8859-1")), r"\r\n?", "\n")
    page = lambda t, i: F.struct((i + 1).cast("int").alias("page_number"), t.alias("text"), F.lit("native_text").alias("page_type"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("error"))
    texts = files.where(F.col("file_type").isin(*TEXT)).select("path", F.transform(split_pages(raw), page).cast(f"array<{PAGE}>").alias("pages"), F.create_map(F.lit("encoding_used"), F.when(valid.isNotNull(), "utf-8").otherwise("latin-1"), F.lit("raw_length"), F.length(raw).cast("string")).alias("metadata"), F.array().cast("array<string>").alias("errors"))
    by_extension = readers.by_extension

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                try:
                    if row.file_type not in by_extension:
                        raise ValueError(f"no reader for .{row.file_type}")
                    found, meta = by_extension[row.file_type](row.content)
                    pages = [{"page_number": i, "text": t, "page_type": k, "confidence": c, "error": None} for i, (t, k, c) in enumerate(found, 1)]
                    out = (row.path, pages, meta, [])
                except Exception as e:  # one bad file must not end the job
                    out = (row.path, [], {}, [f"{type(e).__name__}: {e}"])
                yield pd.DataFrame([out], columns=["path", "pages", "metadata", "errors"])

    others = files.where(~F.col("file_type").isin(*TEXT)).select("path", "content", "file_type").mapInPandas(parse, PARSED)
    both = texts.unionByName(others).withColumn("file_type", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    return both.withColumn("status", ingest_status(F.size("pages"), F.size("errors")))


def until_failure(results: DataFrame, order: str) -> DataFrame:
    """Results up to and with the first that failed."""
    first = results.where("status = 'failed'").agg(F.min(order).alias("__first"))
    return results.join(F.broadcast(first)).where(F.col("__first").isNull() | (F.col(order) <= F.col("__first"))).drop("__first")


def failure(spark: SparkSession, path: str, reason: str) -> DataFrame:
    return spark.createDataFrame([(path, "", [], {}, [reason], "failed")], f"path string, file_type string, pages array<{PAGE}>, metadata map<string,string>, errors array<string>, status string")
