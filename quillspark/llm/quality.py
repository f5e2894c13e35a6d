"""Quality by hierarchical empirical Bayes.

A document classifier gives each text the probability to be good. Hosts and paths get Beta posteriors from the sums of these
probabilities: a host's mean shrinks toward the global one by a strength that is fitted to how much hosts differ, a path's
mean toward its host's by one fitted to how much paths differ within hosts. A document's score joins the odds of its own text with the odds of its path, without itself.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import checkpointed, join_stats, written

TOKEN = re.compile(r"\w+|[^\w\s]+")
#: A token is evidence if it is in at least this many sample texts and so many times (as a logarithm) likelier in bad ones.
SUPPORT, LIFT = 6, 2.5
CLIP = 12.0


@dataclass
class Evidence:
    """Logistic regression over what bad words and the shape of a text tell."""

    bad: dict[str, float]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float  # of good texts in the sample

    def good(self, text: str | None) -> float:
        z = (shape(text or "", self.bad) - self.mean) / self.scale
        return float(1 / (1 + np.exp(-np.clip(z @ self.weights[1:] + self.weights[0], -CLIP, CLIP))))


def shape(text: str, bad: dict[str, float]) -> np.ndarray:
    tokens = TOKEN.findall(text)
    n = len(tokens) or 1
    counts = Counter(tokens)
    folded = {t.lower() for t in counts}
    hits = folded & bad.keys()
    marks = sum(c for t, c in counts.items() if not (t[0].isalnum() or t[0] == "_") and len(t) > 1 or t == "|")
    upper = sum(c for t, c in counts.items() if len(t) > 1 and t.isupper())
    most = max(counts.values(), default=0)
    return np.array([min(len(hits), 5), min(sum(bad[t] for t in hits), 20.0), len(counts) / n * np.log1p(n), len(counts) / n, most / n, marks / n, upper / n, np.log1p(n)])


def fit_evidence(labelled: list[tuple[str, int]], rounds: int = 400) -> Evidence | None:
    """``labelled``: (text, 1 for good and 0 for bad). None unless there are both."""
    y = np.array([g for _, g in labelled], float)
    if not len(y) or y.all() or not y.any():
        return None
    inside: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for text, good in labelled:
        inside[good].update({t.lower() for t in TOKEN.findall(text)})
    n = {g: int((y == g).sum()) for g in (0, 1)}
    lift = {t: float(np.log((c + 0.5) / (n[0] + 1)) - np.log((inside[1][t] + 0.5) / (n[1] + 1))) for t, c in inside[0].items() if c >= SUPPORT}
    bad = {t: x for t, x in lift.items() if x >= LIFT}
    x = np.array([shape(t, bad) for t, _ in labelled])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    w = np.zeros(z.shape[1])
    for _ in range(30):  # Newton's method with a ridge
        p = 1 / (1 + np.exp(-np.clip(z @ w, -CLIP, CLIP)))
        ridge = 0.01 * len(z) * np.eye(len(w)) / 10
        w += np.linalg.solve((z.T * (p * (1 - p) + 1e-9)) @ z + ridge, z.T @ (y - p) - ridge @ w)
    return Evidence(bad, mean, scale, w, float(y.mean()))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4000, id_col: str = "doc_id", text_col: str = "text", seed: int = 11) -> Evidence | None:
    """Evidence from about ``sample`` labelled texts (at most twice that), chosen by a hash of the id. A text is bad if its
    quality is 0 or it is toxic.

    Edge cases: rows with a null id are no one's label; a null text is an empty one; labels that come again count each, up to the
    bound. None where there are no labels, or of one kind alone; other columns are not read."""
    wanted = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select(F.col("doc_id").alias("__id"), F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0).alias("__good"))
    wanted = wanted.withColumn("__rank", F.pmod(F.xxhash64("__id", F.lit(seed)), F.lit(1_000_000)))
    n = wanted.count()
    # A bounded set of labels, by ``sample``; texts are joined to it.
    chosen = wanted.where(F.col("__rank") < F.lit(1_000_000 * min(1.0, sample / max(n, 1)))).select("__id", "__good").limit(2 * sample)
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "__id").select("__id", "text", "__good").limit(2 * sample).collect()
    return fit_evidence([(r["text"], r["__good"]) for r in sorted(rows, key=lambda r: (r["__id"], r["__good"]))])


def evidence_of(text: Column, evidence: Evidence | None) -> Column:
    """Probability that a text is good; 0.5 for all without evidence."""

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([0.5 if evidence is None else round(evidence.good(t), 9) for t in texts], dtype="float64")

    return of(text)


def _odds(p: Column) -> Column:
    safe = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(safe / (1 - safe))


def moment_strength(spread: float, groups: float, n: float, square: float, within: float) -> float:
    """Documents that a prior is worth, by moments: ``spread`` sums n * (mean - prior) ** 2 over the groups, of which ``groups``
    are free to differ; ``square`` sums n ** 2 over n of what they are shrunk to. What groups differ by beyond the variance
    ``within`` that their numbers of documents explain is theirs; without any, the prior is worth 1000."""
    between = (spread - groups * within) / max(n - square, 1e-9)
    return min(max(within / between - 1, 1.0), 1000.0) if between > 0 else 1000.0


def score_quality(docs: DataFrame, evidence: Evidence | None, host: Column, path: Column, text_col: str = "text", threshold: float = 0.5, path_strength: float | None = None, keep_columns: list[str] | None = None) -> DataFrame:
    """``keep_columns`` (all of ``docs``) of every row with __q: a struct of evidence, host_mean, path_mean, score and keep.

    ``host`` and ``path`` are columns over ``docs``; a path counts within its host. Both strengths of shrinking are fitted, unless
    ``path_strength`` is given. Texts are scored once: what is kept of a row is written with its probability and read again.
    Sums per path come first, then hosts are sums of paths, so that a hot host is as many groups as it has paths and is summed
    before the shuffle anyway.

    Edge cases: null hosts are one host and null paths one path in each; a null or empty text has the evidence of no words; a
    path with one document has its host's mean. Column names of ``docs`` may be any but those that begin with ``__``.
    Repeated rows stay; an empty table gives no rows.
    """
    keep_columns = docs.columns if keep_columns is None else keep_columns
    name = lambda c: F.coalesce(F.concat(F.lit("s"), c.cast("string")), F.lit("n"))
    rows = written(docs.select(*[F.col(f"`{c}`") for c in keep_columns], name(host).alias("__host"), name(path).alias("__path"), evidence_of(F.col(text_col), evidence).alias("__p"), F.monotonically_increasing_id().alias("__row")))
    paths = checkpointed(rows.groupBy("__host", "__path").agg(F.sum("__p").alias("__sum"), F.count("*").alias("__n")))
    hosts = checkpointed(paths.groupBy("__host").agg(F.sum("__sum").alias("__host_sum"), F.sum("__n").alias("__host_n"), F.count("*").alias("__paths"), F.sum(F.col("__n").cast("double") * F.col("__n")).alias("__square")))
    mean = lambda s, n: F.col(s) / F.col(n)
    total, n, n_hosts, n_paths, inner, square = hosts.agg(
        F.coalesce(F.sum("__host_sum"), F.lit(0.0)), F.coalesce(F.sum("__host_n"), F.lit(0)), F.count("*"), F.coalesce(F.sum("__paths"), F.lit(0)),
        F.coalesce(F.sum(F.col("__host_n") * mean("__host_sum", "__host_n") * (1 - mean("__host_sum", "__host_n"))), F.lit(0.0)), F.coalesce(F.sum(F.col("__square") / F.col("__host_n")), F.lit(0.0)),
    ).first()
    prior = (total + 1) / (n + 2)
    spread, of_hosts = hosts.agg(F.coalesce(F.sum(F.col("__host_n") * F.pow(mean("__host_sum", "__host_n") - F.lit(prior), 2)), F.lit(0.0)), F.coalesce(F.sum(F.pow(F.col("__host_n").cast("double"), 2)), F.lit(0.0))).first()
    strength = moment_strength(spread, n_hosts - 1, n, of_hosts / max(n, 1), prior * (1 - prior))
    host_mean = (F.col("__host_sum") + F.lit(strength * prior)) / (F.col("__host_n") + F.lit(strength))
    both = checkpointed(paths.join(hosts, "__host").select("__host", "__path", "__sum", "__n", host_mean.alias("__host_mean"), mean("__host_sum", "__host_n").alias("__own_mean")))
    if path_strength is None:
        (differ,) = both.agg(F.coalesce(F.sum(F.col("__n") * F.pow(mean("__sum", "__n") - F.col("__own_mean"), 2)), F.lit(0.0))).first()
        path_strength = moment_strength(differ, n_paths - n_hosts, n, square, inner / max(n, 1))
    joined = join_stats(rows, both.drop("__own_mean"), ["__host", "__path"], F.col("__row"))
    path_mean = (F.col("__sum") - F.col("__p") + F.lit(path_strength) * F.col("__host_mean")) / (F.col("__n") - 1 + F.lit(path_strength))
    learned = evidence.prior if evidence else 0.5
    score = 1 / (1 + F.exp(-(_odds(F.col("__p")) - _odds(F.lit(learned)) + _odds(path_mean))))
    fields = {"evidence": F.col("__p"), "host_mean": F.col("__host_mean"), "path_mean": path_mean, "score": score}
    detail = F.struct(*[F.round(c, 6).alias(k) for k, c in fields.items()], (score >= threshold).alias("keep"))
    return joined.select(*[F.col(f"`{c}`") for c in keep_columns], detail.alias("__q"))
