"""URL judgement: host and path rules first, then a weighted vocabulary found with an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import LOWER, UPPER, ascii_lower

#: One of these in a URL rejects it.
STRICT_TERMS = ("casino", "escort", "hentai", "jackpot", "malware", "phishing", "porn", "pornhub", "sexcam", "warez", "xxx")
#: Several different ones of these reject it.
SOFT_TERMS = ("adult", "bet", "betting", "bonus", "cam", "cheap", "crack", "dating", "keygen", "loan", "nude", "pills", "poker", "replica", "sex", "slots", "torrent", "viagra")
SOFT_LIMIT = 2
_FOLD = str.maketrans(UPPER, LOWER)


@dataclass(frozen=True)
class Rule:
    """``verdict`` (allow or block) for a host with its subdomains, for paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def term_hits(url: Column, strict: tuple[str, ...] = STRICT_TERMS, soft: tuple[str, ...] = SOFT_TERMS) -> Column:
    """Struct of the number of strict hits and of distinct soft terms; a hit has no ASCII letter or digit beside it."""
    weights = {t: "soft" for t in soft} | {t: "strict" for t in strict}

    @F.pandas_udf("strict int, soft int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        found = ahocorasick.Automaton()  # once a task
        for term, kind in weights.items():
            found.add_word(term, (term, kind))
        found.make_automaton()
        inner = lambda c: c.isascii() and c.isalnum()

        def one(url: str | None) -> tuple[int, int]:
            text, strict_hits, soft_terms = (url or "").translate(_FOLD), 0, set()
            for end, (term, kind) in found.iter(text):
                start = end - len(term) + 1
                if not (start and inner(text[start - 1])) and not (end + 1 < len(text) and inner(text[end + 1])):
                    if kind == "strict":
                        strict_hits += 1
                    else:
                        soft_terms.add(term)
            return strict_hits, len(soft_terms)

        for urls in batches:
            yield pd.DataFrame([one(u) for u in urls], columns=["strict", "soft"]).astype("int32")

    return count(url)


def vocabulary(terms: DataFrame, most: int = 1_000_000) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Strict and soft terms of a table (term, strict), lower-cased; a term that is both is strict. Null and empty terms are none.

    A vocabulary is what every task holds, so one of over ``most`` terms is an error."""
    known = terms.where(F.length("term") > 0).groupBy(ascii_lower(F.col("term")).alias("term")).agg(F.max("strict").alias("strict")).limit(most + 1).collect()
    if len(known) > most:
        raise ValueError(f"more than {most} terms")
    return tuple(sorted(r["term"] for r in known if r["strict"])), tuple(sorted(r["term"] for r in known if not r["strict"]))


def judge_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", strict: tuple[str, ...] = STRICT_TERMS, soft: tuple[str, ...] = SOFT_TERMS, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """``id_col``, host, path, rule, verdict, strict_hits, soft_hits of every row.

    The longest fitting rule decides; without one, one strict hit or ``soft_limit`` different soft terms block. ``vocabulary`` reads
    the terms of a table.
    Edge cases: a null url and one without ``://`` have empty host and path, so that no rule fits; a null url has no hits and
    is allowed. Repeated rows and null ids stay; an empty table gives no rows; other columns, whatever their names, are not read.
    """
    parts = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url")).select("__id", "__url", host_of(F.col("__url")).alias("host"), path_of(F.col("__url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    hits = parts.withColumns({"rule": rule, "__verdict": verdict, "__hits": term_hits(F.col("__url"), strict, soft)})
    by_terms = F.when((F.col("__hits.strict") > 0) | (F.col("__hits.soft") >= soft_limit), "block").otherwise("allow")
    return hits.select(F.col("__id").alias(id_col), "host", "path", "rule", F.coalesce("__verdict", by_terms).alias("verdict"), F.col("__hits.strict").alias("strict_hits"), F.col("__hits.soft").alias("soft_hits"))
