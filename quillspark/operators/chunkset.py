"""Operators over chunk rows: statistics, look-up and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def statistics(docs: DataFrame, chunks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: number and sizes of its chunks, their types, depths, and how the original's size compares. Documents
    without chunks have zeros. Types are counted first, so that what is collected is one entry a type."""
    size = F.length("content")
    kinds = chunks.groupBy(id_col, F.col("metadata")["type"].alias("type")).agg(F.count("*").alias("n"), F.sum(size).alias("total"), F.min(size).alias("least"), F.max(size).alias("most"), F.max(F.size("hierarchy")).alias("deepest"), F.sum(F.size("hierarchy")).alias("depths"))
    per = kinds.groupBy(id_col).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"), F.max("deepest").alias("deepest"), F.sum("depths").alias("depths"), F.array_sort(F.collect_list(F.struct("type", "n"))).alias("types"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return docs.select(id_col, F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("original_size")).join(per, id_col, "left").select(
        id_col, zero(F.col("n")).cast("long").alias("total_chunks"), zero(F.col("total")).cast("long").alias("total_characters"), F.coalesce(F.col("total") / F.col("n"), F.lit(0.0)).alias("avg_chunk_size"),
        zero(F.col("least")).alias("min_chunk_size"), zero(F.col("most")).alias("max_chunk_size"), F.coalesce("types", F.array().cast("array<struct<type:string,n:bigint>>")).alias("chunk_types"),
        zero(F.col("deepest")).alias("max_hierarchy_depth"), F.coalesce(F.col("depths") / F.col("n"), F.lit(0.0)).alias("avg_hierarchy_depth"), "original_size", F.coalesce(F.col("original_size") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0)).alias("compression_ratio"),
    )


def by_id(chunks: DataFrame, chunk_id: str) -> DataFrame:
    """The first chunk of that id."""
    return chunks.where(F.col("chunk_id") == chunk_id).orderBy("ordinal").limit(1)


def by_hierarchy(chunks: DataFrame, path: list[str]) -> DataFrame:
    return chunks.where(F.slice("hierarchy", 1, max(len(path), 1)) == F.array(*[F.lit(p) for p in path])) if path else chunks


def markdown(separator: str = "\n\n---\n\n") -> tuple[Column, str]:
    """A chunk as Markdown, and what stands between two: a heading as deep as the hierarchy, six at most, then the content."""
    deep = F.size("hierarchy")
    heading = F.when(deep > 0, F.concat(F.repeat(F.lit("#"), F.least(deep, F.lit(6))), F.lit(" "), F.element_at("hierarchy", -1))).otherwise(F.concat(F.lit("## Chunk "), (F.col("ordinal") + 1).cast("string")))
    return F.concat(heading, F.lit("\n\n"), F.col("content")), separator


def export(chunks: DataFrame, kind: str, id_col: str = "doc_id", include_metadata: bool = True) -> DataFrame:
    """``id_col``, ordinal and the chunk as text of ``kind``: json, csv (one line, fields quoted) or markdown."""
    if kind == "json":
        extra = [F.col("metadata"), F.col("start_pos"), F.col("end_pos")] if include_metadata else []
        body = F.to_json(F.struct(F.col("chunk_id").alias("id"), "content", "hierarchy", *extra))
    elif kind == "csv":
        flat = F.struct("chunk_id", F.replace(F.col("content"), F.lit("\n"), F.lit(" ")).alias("content"), F.array_join("hierarchy", " > ").alias("hierarchy"), *(["start_pos", "end_pos"] if include_metadata else []))
        body = F.to_csv(flat, {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
    elif kind == "markdown":
        body, _ = markdown()
    else:
        raise ValueError(f"no export as {kind!r}; there are json, csv and markdown")
    return chunks.select(id_col, "ordinal", body.alias("body"))


def export_documents(chunks: DataFrame, kind: str, id_col: str = "doc_id", include_metadata: bool = True, separator: str = "\n\n---\n\n") -> DataFrame:
    """``id_col`` and body: all chunks of a document, in order, as one text. JSON is an array, CSV has a line of names, Markdown has
    ``separator`` between chunks. Documents without chunks give no row."""
    each = export(chunks, kind, id_col, include_metadata)
    bodies = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "body"))), lambda x: x["body"])
    names = ",".join(["chunk_id", "content", "hierarchy", *(["start_pos", "end_pos"] if include_metadata else [])])
    laid = {"json": lambda b: F.concat(F.lit("["), F.array_join(b, ",\n"), F.lit("]")), "csv": lambda b: F.concat(F.lit(names + "\n"), F.array_join(b, "\n")), "markdown": lambda b: F.array_join(b, separator)}
    return each.groupBy(id_col).agg(laid[kind](bodies).alias("body"))


def first_in(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, by ``order``."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
