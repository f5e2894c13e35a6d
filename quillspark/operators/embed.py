"""Embedding of chunks through named providers; the default one needs no model and stays in the JVM."""

from __future__ import annotations

import fnmatch
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.lineage import checkpointed
from quillspark.functions.vectors import content_id, l2_normalize, md5_embedding

#: (text column, dimension) -> vector column.
Provider = Callable[[Column, int], Column]


# What models of a name want before questions and before passages.
PREFIXES = {"*e5-*": ("query: ", "passage: "), "*bge-m3*": ("Represent this sentence for searching relevant passages: ", "")}


@dataclass(frozen=True)
class EmbedConfig:
    model: str = "md5"
    fallback: str | None = "md5"
    dim: int = 64
    normalize: bool = True
    query_prefix: str = ""
    passage_prefix: str = ""

    def __post_init__(self):
        if self.dim <= 0 or not self.model:
            raise ValueError("a model and a positive dimension are needed")


def for_model(model: str, **more) -> EmbedConfig:
    """The configuration of a model, with the prefixes that models of its name want."""
    query, passage = next((p for name, p in PREFIXES.items() if fnmatch.fnmatch(model.lower(), name)), ("", ""))
    return EmbedConfig(**{"model": model, "query_prefix": query, "passage_prefix": passage} | more)


class Providers:
    """By exact name without case, else by pattern such as ``maker/*``."""

    def __init__(self):
        self.known: dict[str, Provider] = {"md5": md5_embedding}

    def register(self, name: str, provider: Provider) -> None:
        self.known[name.lower()] = provider

    def get(self, name: str) -> Provider:
        name = name.lower()
        if name in self.known:
            return self.known[name]
        for pattern, provider in self.known.items():
            if "*" in pattern and fnmatch.fnmatch(name, pattern):
                return provider
        raise ValueError(f"no embedding model {name!r}; there are {sorted(self.known)}")

    def resolve(self, config: EmbedConfig) -> tuple[str, Provider]:
        """The model or, where there is none of that name, the fallback."""
        for name in filter(None, (config.model, config.fallback)):
            try:
                return name, self.get(name)
            except ValueError:
                continue
        raise RuntimeError(f"neither {config.model!r} nor {config.fallback!r} can be loaded")


PROVIDERS = Providers()


def vector_of(text: Column, config: EmbedConfig, prefix: str = "", providers: Providers = PROVIDERS) -> Column:
    _, provider = providers.resolve(config)
    v = provider(F.concat(F.lit(prefix), text) if prefix else text, config.dim)
    return l2_normalize(v) if config.normalize and provider is not md5_embedding else v


def embed_chunks(chunks: DataFrame, config: EmbedConfig = EmbedConfig(), text_col: str = "content", source_file: Column | None = None, providers: Providers = PROVIDERS) -> DataFrame:
    """``chunks`` with embedding, model_name, embedding_dim and source_file; a chunk without an id gets one of its content."""
    name, _ = providers.resolve(config)
    ident = F.coalesce(F.nullif(F.col("chunk_id"), F.lit("")), content_id(F.col(text_col))) if "chunk_id" in chunks.columns else content_id(F.col(text_col))
    return chunks.withColumns({"chunk_id": ident, "embedding": vector_of(F.col(text_col), config, config.passage_prefix, providers), "model_name": F.lit(name), "embedding_dim": F.lit(config.dim), "source_file": F.lit(None).cast("string") if source_file is None else source_file})


def content_hash(text: Column, config: EmbedConfig) -> Column:
    """What a vector depends on besides its model: the text with its prefix, the dimension, and whether it is scaled."""
    return F.sha2(F.concat_ws("|", F.lit(config.dim), F.lit(config.normalize), F.concat(F.lit(config.passage_prefix), text)), 256)


def embed_new(chunks: DataFrame, known: DataFrame | None, config: EmbedConfig = EmbedConfig(), text_col: str = "content", source_file: Column | None = None, providers: Providers = PROVIDERS) -> DataFrame:
    """``embed_chunks`` that asks the provider for no vector that ``known`` (document, content_hash, embedding) has. ``chunks`` has a
    column document, is read twice and gets content_hash. Chunks of documents that aren't known, and changed ones, are embedded."""
    hashed = chunks.withColumn("content_hash", content_hash(F.col(text_col), config))
    if known is None:
        return embed_chunks(hashed, config, text_col, source_file, providers)
    there = known.select("document", "content_hash", F.col("embedding").cast("array<double>").alias("__vector"))
    kept = embed_chunks(hashed.join(there, ["document", "content_hash"]).select(*hashed.columns, "__vector"), config, text_col, source_file, providers).withColumn("embedding", F.col("__vector")).drop("__vector")
    return kept.unionByName(embed_chunks(hashed.join(there, ["document", "content_hash"], "left_anti").select(*hashed.columns), config, text_col, source_file, providers))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``, their place from 0 by ``order``: rows are sorted into ranges, of which each is counted, and a row's
    place is its place in its range and the rows of all before."""
    ranged, nth = checkpointed(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())), Window.partitionBy("__part").orderBy(*order)
    before = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = before.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))  # a row a range
    return ranged.join(F.broadcast(before), "__part").withColumn(name, F.row_number().over(nth) - 1 + F.col("__before")).drop("__part", "__before")


def embed_texts(texts: DataFrame, config: EmbedConfig = EmbedConfig(), text_col: str = "text", order: list[str] | None = None, providers: Providers = PROVIDERS) -> DataFrame:
    """``texts`` embedded as chunks. Ids are ``text_`` and the place by ``order``, or without it ``text_`` and a hash of the text, which
    needs no sorting of all rows."""
    if order is None:
        named = texts.withColumn("chunk_id", F.concat(F.lit("text_"), F.replace(content_id(F.col(text_col)), F.lit("chunk_"), F.lit(""))))
    else:
        named = numbered(texts, order, "__place").withColumn("chunk_id", F.concat(F.lit("text_"), F.col("__place").cast("string"))).drop("__place")
    return embed_chunks(named, config, text_col, providers=providers)


def failures(embedded: DataFrame) -> DataFrame:
    """chunk_id, error of the chunks without a vector."""
    return embedded.where(F.coalesce(F.size("embedding"), F.lit(0)) <= 0).select("chunk_id", F.lit("no vector").alias("error"))


def embed_each(embed: Callable[[list[str], int], list[list[float]]], texts: list[str], dim: int, retries: int, delay: float) -> list[list[float] | None]:
    """Vectors of ``texts``, null for those that can't be embedded. A whole batch is tried again, since a service may be down for a
    while; if it still fails, its halves are tried, and theirs, so that one bad text of n costs itself and about 2 log2 n calls."""

    def tried(some: list[str], left: int) -> list | None:
        for left in range(left, -1, -1):
            try:
                found = list(embed(some, dim))
                if len(found) == len(some):
                    return found
            except Exception:  # whatever a model raises
                pass
            if left:
                time.sleep(delay)
        return None

    out: list[list[float] | None] = [None] * len(texts)
    todo = [(0, len(texts), retries)]
    while todo:
        at, to, left = todo.pop()
        if at == to:
            continue
        if (found := tried(texts[at:to], left)) is not None:
            out[at:to] = found
        elif to - at > 1:
            half = (at + to) // 2
            todo += [(half, to, 0), (at, half, 0)]
    return out


def with_retry(embed: Callable[[list[str], int], list[list[float]]], retries: int = 2, delay: float = 1.0) -> Provider:
    """A provider of a Python function over texts, called once a batch, and again as ``embed_each`` says after an error."""

    def provider(text: Column, dim: int) -> Column:
        @F.pandas_udf("array<double>")
        def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series(embed_each(embed, texts.tolist(), dim, retries, delay), dtype="object")

        return of(text)

    return provider


def model_info(config: EmbedConfig, providers: Providers = PROVIDERS) -> dict:
    name, _ = providers.resolve(config)
    return {"model": name, "asked_for": config.model, "is_fallback": name.lower() != config.model.lower(), "embedding_dim": config.dim, "normalize": config.normalize}


def usable(embedded: DataFrame) -> DataFrame:
    return embedded.where(F.size("embedding") > 0)


def summary(embedded: DataFrame) -> DataFrame:
    """One row: total, successful and failed vectors, their dimension, the status that follows, and all that as text."""
    good = F.count_if(F.coalesce(F.size("embedding") > 0, F.lit(False)))
    row = embedded.agg(F.count("*").alias("total"), good.alias("successful"), (F.count("*") - good).alias("failed"), F.max(F.size("embedding")).alias("embedding_dim"), status(good, F.count("*")).alias("status"))
    return row.withColumn("summary", F.format_string("%s: %d of %d embedded, %d failed, dimension %d", "status", "successful", "total", "failed", F.coalesce("embedding_dim", F.lit(0))))


def status(successful: Column, total: Column) -> Column:
    return F.when(successful == total, "success").when(successful > 0, "partial").otherwise("failed")
