"""What kind of structure a document has: the first of five tests that holds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import let, paragraphs, wide

NUMBERED, STATUTE, POLICY, LAYOUT, UNSTRUCTURED = "numbered_sections", "statute", "policy_or_terms", "layout_based", "unstructured"
# The patterns that tell the kinds apart.
NUMBERED_PATTERNS = (r"\n\d+\.\s+[A-Z][A-Z\s]{2,}", r"\n\d+\.\d+\s+[A-Z]", r"(?m)^\d+\.\s+[A-Z][A-Z\s]{2,}")
STATUTE_PATTERNS = {"article": r"(?i)Article\s+\d+", "art": r"(?i)Art\.\s+\d+", "section": r"(?i)Section\s+\d+", "paragraph_sign": r"§\s*\d+"}
CLAUSES = r"(?i)Clause\s+\d+|Para\.\s+\d+|\(\d+\)"
LIST_PATTERNS = {"letter": r"\([a-z]\)", "roman": r"\([ivx]+\)", "bullet": r"\n\s*[•●○]\s", "dash": r"\n\s*-\s+[A-Z]"}
DEPTH = r"\d+\.\d+\.?\d*"
# What each kind is divided by, first and then.
DELIMITERS = {NUMBERED: ("numbered_section", "subsection"), STATUTE: ("article", "clause"), POLICY: ("paragraph", "list_item"), LAYOUT: ("heading", "paragraph"), UNSTRUCTURED: ("paragraph", None)}


@dataclass(frozen=True)
class DetectOptions:
    numbered_least: int = 3
    statute_least: int = 2
    list_least: int = 5
    headings_least: int = 3


def _each(text: Column, patterns) -> Column:
    """How often each pattern is met."""
    return F.array(*[F.regexp_count(text, F.lit(wide(p))) for p in patterns])


def _sum(counts: Column) -> Column:
    return F.reduce(counts, F.lit(0), lambda s, n: s + n)


def numbered_count(text: Column) -> Column:
    """Matches of all patterns; a header that two of them match counts twice."""
    return _sum(_each(text, NUMBERED_PATTERNS))


def statute_count(text: Column) -> Column:
    return _sum(_each(text, STATUTE_PATTERNS.values()))


def list_count(text: Column) -> Column:
    return _sum(_each(text, LIST_PATTERNS.values()))


def is_sequential(text: Column) -> Column:
    """Whether the different leading numbers of headers are on average at most two apart; true for fewer than two."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(wide(p)), F.lit(0)) for p in NUMBERED_PATTERNS])
    numbers = F.array_distinct(F.transform(found, lambda m: F.regexp_extract(m, wide(r"\d+"), 0).try_cast("bigint")))
    return let(numbers, lambda n: F.coalesce((F.array_max(n) - F.array_min(n)) / F.nullif(F.size(n) - 1, F.lit(0)) <= 2, F.lit(True)))


def max_depth(text: Column) -> Column:
    """Most full stops in any dotted number of the text, amounts of money too; 1 without any."""
    dots = F.transform(F.regexp_extract_all(text, F.lit(wide(DEPTH)), F.lit(0)), lambda m: F.length(m) - F.length(F.replace(m, F.lit("."), F.lit(""))))
    return F.coalesce(F.array_max(dots), F.lit(1))


def _headings(layout_col: str | None) -> Column:
    return F.coalesce(F.size(F.col(f"{layout_col}.headings")), F.lit(0)) if layout_col else F.lit(0)


def kind_of(text: Column, layout_col: str | None = None, options: DetectOptions = DetectOptions()) -> Column:
    """The kind alone: later tests don't run where an earlier one holds."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(numbered_count(t) >= options.numbered_least, NUMBERED).when(statute_count(t) >= options.statute_least, STATUTE)
        .when(list_count(t) >= options.list_least, POLICY).when(_headings(layout_col) >= options.headings_least, LAYOUT).otherwise(UNSTRUCTURED)
    )


def detect(docs: DataFrame, text_col: str = "text", layout_col: str | None = None, options: DetectOptions = DetectOptions()) -> DataFrame:
    """``docs`` with ``detection``: a struct of the kind, the confidence and what the tests found. The text is the uncleaned one;
    a null text is an empty one. ``layout_col`` is a struct with an array ``headings`` of structs with ``level``. Each pattern is
    counted once."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    found = F.struct(
        _each(t, NUMBERED_PATTERNS).alias("numbered"), _each(t, STATUTE_PATTERNS.values()).alias("statute"), _each(t, LIST_PATTERNS.values()).alias("listed"), _headings(layout_col).alias("headings"),
        F.size(F.split(t, "\n", -1)).alias("lines"), F.transform(paragraphs(t), F.length).alias("paragraphs"), max_depth(t).alias("depth"),
    )
    levels = F.size(F.array_distinct(F.transform(F.col(f"{layout_col}.headings"), lambda h: h["level"]))) if layout_col else F.lit(0)
    sums = lambda d: F.struct(_sum(d["numbered"]).alias("numbered"), _sum(d["statute"]).alias("statute"), _sum(d["listed"]).alias("listed"))
    return docs.withColumn("detection", let(found, lambda d: let(sums(d), lambda n: _detection(t, d, n, levels, options))))


def _detection(t: Column, d: Column, n: Column, levels: Column, options: DetectOptions) -> Column:
    density = n["listed"] / d["lines"]
    cascade = [
        (NUMBERED, n["numbered"] >= options.numbered_least, F.least(F.lit(0.9), F.lit(0.6) + 0.05 * n["numbered"]), d["depth"]),
        (STATUTE, n["statute"] >= options.statute_least, F.least(F.lit(0.85), F.lit(0.5) + 0.1 * n["statute"]), F.lit(2)),
        (POLICY, n["listed"] >= options.list_least, F.least(F.lit(0.75), F.lit(0.4) + 10 * density), F.lit(2)),
        (LAYOUT, d["headings"] >= options.headings_least, F.least(F.lit(0.8), F.lit(0.5) + 0.05 * d["headings"]), levels),
    ]
    hints = lambda kind, depth: F.struct(F.lit(DELIMITERS[kind][0]).alias("primary_delimiter"), F.lit(DELIMITERS[kind][1]).cast("string").alias("secondary_delimiter"), depth.alias("hierarchy_depth"), F.lit(kind == UNSTRUCTURED).alias("fallback"))
    said = lambda kind, sure, depth: F.struct(F.lit(kind).alias("doc_type"), sure.alias("confidence"), hints(kind, depth).alias("hints")).cast("struct<doc_type:string,confidence:double,hints:struct<primary_delimiter:string,secondary_delimiter:string,hierarchy_depth:int,fallback:boolean>>")
    decided = said(UNSTRUCTURED, F.lit(1.0), F.lit(1))
    for kind, holds, sure, depth in reversed(cascade):
        decided = F.when(holds, said(kind, sure, depth)).otherwise(decided)
    named = lambda counts, names: F.filter(F.transform(F.array(*map(F.lit, names)), lambda x, i: F.when(F.get(counts, i) > 0, x)), lambda x: x.isNotNull())
    dominant = F.get(F.array(*map(F.lit, LIST_PATTERNS)), F.array_position(d["listed"], F.array_max(d["listed"])).cast("int") - 1)
    lengths = d["paragraphs"]
    return let(decided, lambda said: F.struct(
        said["doc_type"].alias("doc_type"), said["confidence"].alias("confidence"), n["numbered"].alias("section_count"), is_sequential(t).alias("is_sequential"), d["depth"].alias("max_depth"),
        n["statute"].alias("article_count"), named(d["statute"], STATUTE_PATTERNS).alias("pattern_types"), F.regexp_count(t, F.lit(wide(CLAUSES))).alias("clause_count"),
        n["listed"].alias("list_count"), density.alias("list_density"), dominant.alias("dominant_pattern"), d["headings"].alias("heading_count"),
        F.size(lengths).alias("paragraph_count"), F.coalesce(_sum(lengths) / F.nullif(F.size(lengths), F.lit(0)), F.lit(0.0)).alias("avg_paragraph_length"), said["hints"].alias("structure_hints"),
    ))


def heading_levels(headings: Column) -> Column:
    """Histogram of an array of structs with ``level``, as a map."""
    levels = F.transform(headings, lambda h: h["level"])
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(levels)), lambda l: F.struct(l, F.size(F.filter(levels, lambda x: x == l)))))
