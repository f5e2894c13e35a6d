"""Answers for a table of questions: their contexts gathered, prompts filled in, and one provider of answers a task."""

from __future__ import annotations

import fnmatch
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators import chat

CONTEXTS = "array<struct<text:string,score:double,source_file:string,hierarchy:array<string>,page_numbers:array<int>>>"


class Answerer(Protocol):
    """Answers a prompt; ``passages`` are the contexts' texts in order, for those that need no model."""

    def __call__(self, prompt: str, passages: list[str]) -> str: ...


def extractive(prompt: str, passages: list[str]) -> str:
    """Offline answer: the best passage."""
    return passages[0] if passages else "No passage answers this."


class AnswerProviders:
    """Factories by exact name without case, else by pattern such as ``maker/*``. A factory is called once in each task that answers,
    in the worker, so that what it makes (a client, a model) needn't be sent there."""

    def __init__(self):
        self.known: dict[str, Callable[[], Answerer]] = {"extractive": lambda: extractive}

    def register(self, name: str, factory: Callable[[], Answerer]) -> None:
        self.known[name.lower()] = factory

    def get(self, name: str) -> Callable[[], Answerer]:
        name = name.lower()
        found = self.known.get(name) or next((f for p, f in self.known.items() if "*" in p and fnmatch.fnmatch(name, p)), None)
        if found is None:
            raise ValueError(f"no provider of answers {name!r}; there are {sorted(self.known)}")
        return found


PROVIDERS = AnswerProviders()


def gather(found: DataFrame, collection: DataFrame, id_col: str = "id", query_id: str = "query_id") -> DataFrame:
    """``query_id`` and contexts, in order of rank, of (``query_id``, rank, ``id_col``, score) rows. A question has as many as its search
    gave it, so what is collected is bounded; the texts of the collection cross over once, for those that were found."""
    here, fields = set(collection.columns), {"source_file": "string", "hierarchy": "array<string>", "page_numbers": "array<int>"}
    own = collection.select(id_col, F.col("text").alias("__text"), *[(F.col(c) if c in here else F.lit(None)).cast(t).alias(f"__{c}") for c, t in fields.items()])
    wanted = own.join(found.select(id_col).distinct(), id_col, "left_semi")
    one = F.struct("rank", F.col("__text").alias("text"), F.col("score").cast("double").alias("score"), *[F.col(f"__{c}").alias(c) for c in fields])
    listed = found.join(wanted, id_col).groupBy(query_id).agg(F.sort_array(F.collect_list(one)).alias("contexts"))
    return listed.select(query_id, F.transform("contexts", lambda c: c.dropFields("rank")).cast(CONTEXTS).alias("contexts"))


def prompted(asked: DataFrame, contexts: DataFrame, query_id: str = "query_id") -> DataFrame:
    """``asked`` (``query_id``, text and, if there, n_history, last_user, last_assistant) with contexts, contexts_used, quality, query_type,
    citations, prompt_kind and prompt. Questions without contexts have none; one without text is asked as an empty one."""
    here = set(asked.columns)
    have = lambda c, t: F.col(c).cast(t) if c in here else F.lit(None).cast(t)
    n, user, assistant = F.coalesce(have("n_history", "int"), F.lit(0)), have("last_user", "string"), have("last_assistant", "string")
    text = F.coalesce("text", F.lit(""))
    rows = asked.join(contexts, query_id, "left").withColumn("contexts", F.coalesce("contexts", F.array().cast(CONTEXTS)))
    best = F.coalesce(F.array_max(F.transform("contexts", lambda c: c["score"])), F.lit(0.0))
    rows = rows.withColumns({"contexts_used": F.size("contexts"), "quality": chat.quality(best), "query_type": chat.classify(text, n, user), "citations": chat.citations(F.col("contexts"))})
    rows = rows.withColumn("prompt_kind", chat.prompt_kind(F.col("query_type"), F.col("quality")))
    return rows.withColumn("prompt", chat.prompt(F.col("prompt_kind"), text, chat.context_text(F.col("contexts")), F.col("citations"), user, assistant))


def _answered(factory: Callable[[], Answerer]):
    @F.pandas_udf("text string, error string")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        answer, broken = None, ""
        try:
            answer = factory()
        except Exception as e:  # whatever a client raises when it is made
            broken = f"{type(e).__name__}: {e}"

        def one(prompt: str, passages) -> tuple[str | None, str | None]:
            if answer is None:
                return None, broken
            try:
                return answer(prompt, list(passages)), None
            except Exception as e:  # whatever a model raises
                return None, f"{type(e).__name__}: {e}"

        for prompts, passages in batches:
            yield pd.DataFrame([one(p, c) for p, c in zip(prompts, passages, strict=True)], columns=["text", "error"])

    return of.asNondeterministic()


def fallback(quality: Column) -> Column:
    out = F.lit(chat.FALLBACKS["none"])
    for band, text in chat.FALLBACKS.items():
        out = F.when(quality == band, text).otherwise(out)
    return out


def answered(rows: DataFrame, factory: Callable[[], Answerer] = lambda: extractive, concise: bool = False) -> DataFrame:
    """``rows`` of ``prompted`` with answer, fallback_used and warning: where the provider fails, or has no answer, a fixed text by the
    contexts' quality stands in, and the warning is what it said. Each row is asked once."""
    system = chat.SYSTEM_CONCISE if concise else chat.SYSTEM
    said = _answered(factory)(F.concat(F.lit(f"{system}\n\n"), "prompt"), F.transform("contexts", lambda c: c["text"]))
    rows = rows.withColumn("__said", said)
    failed = F.col("__said.text").isNull()
    warning = F.when(failed, F.coalesce("__said.error", F.lit("no answer")))
    return rows.withColumns({"answer": F.when(failed, fallback(F.col("quality"))).otherwise(F.col("__said.text")), "fallback_used": failed, "warning": warning}).drop("__said")
