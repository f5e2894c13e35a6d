"""Language identification with a byte convolutional network, trained and applied in numpy.

Bytes are embedded; filters of widths 2, 3 and 4 slide over a window; each filter keeps its maximum; a softmax over the
languages follows. A text is judged by all its windows of fixed length, each weighted by its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import checkpointed

WINDOW, WIDTHS, FILTERS, DIM = 512, (2, 3, 4), 8, 8
#: Windows that go through the network together; their columns stay in a core's cache.
BATCH = 24
UNKNOWN = "und"


@dataclass
class ByteNet:
    labels: list[str]
    embed: np.ndarray  # 256 x DIM
    kernel: np.ndarray  # widest * DIM x filters; rows beyond a filter's width are 0
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @staticmethod
    def mask() -> np.ndarray:
        mask = np.zeros((max(WIDTHS) * DIM, FILTERS * len(WIDTHS)), np.float32)
        for i, width in enumerate(WIDTHS):
            mask[: width * DIM, i * FILTERS : (i + 1) * FILTERS] = 1
        return mask

    @classmethod
    def fresh(cls, labels: list[str], seed: int = 7) -> ByteNet:
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        n = FILTERS * len(WIDTHS)
        return cls(labels, normal(256, DIM, scale=0.5), normal(max(WIDTHS) * DIM, n, scale=0.2) * cls.mask(), np.zeros(n, np.float32), normal(n, len(labels), scale=0.2), np.zeros(len(labels), np.float32))

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """windows (n, length) of bytes -> (n, places, widest * DIM), the input that each place's filters see."""
        x = self.embed[windows]
        places = windows.shape[1] - max(WIDTHS) + 1
        seen = np.empty((len(windows), places, max(WIDTHS) * DIM), np.float32)
        for j in range(max(WIDTHS)):
            seen[:, :, j * DIM : (j + 1) * DIM] = x[:, j : j + places]
        return seen

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        seen = self.columns(windows)
        pooled = (seen.reshape(-1, seen.shape[2]) @ self.kernel).reshape(len(windows), seen.shape[1], -1).max(axis=1)
        return _softmax(np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias)

    def train(self, windows: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 7) -> None:
        """Adam on cross-entropy; only the place of each filter's maximum gets a gradient."""
        rng, mask, step = np.random.default_rng(seed), self.mask(), 0
        names = ("embed", "kernel", "bias", "out", "out_bias")
        mean = {k: np.zeros_like(getattr(self, k)) for k in names}
        square = {k: np.zeros_like(getattr(self, k)) for k in names}
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), batch):
                take = order[i : i + batch]
                seen = self.columns(windows[take])
                response = (seen.reshape(-1, seen.shape[2]) @ self.kernel).reshape(len(take), seen.shape[1], -1)
                place = response.argmax(axis=1)
                raw = np.take_along_axis(response, place[:, None], 1)[:, 0] + self.bias
                hidden = np.maximum(raw, 0)
                p = _softmax(hidden @ self.out + self.out_bias)
                p[np.arange(len(take)), y[take]] -= 1
                p /= len(take)
                back = (p @ self.out.T) * (raw > 0)
                at = seen[np.arange(len(take))[:, None], place]  # (n, filters, widest * DIM)
                grad = {"out": hidden.T @ p, "out_bias": p.sum(0), "bias": back.sum(0), "kernel": np.einsum("nfk,nf->kf", at, back) * mask, "embed": np.zeros_like(self.embed)}
                to_bytes = (back[:, :, None] * self.kernel.T[None]).reshape(len(take), -1, max(WIDTHS), DIM)
                for j in range(max(WIDTHS)):
                    np.add.at(grad["embed"], windows[take][np.arange(len(take))[:, None], place + j], to_bytes[:, :, j])
                step += 1
                for k in names:
                    mean[k] = 0.9 * mean[k] + 0.1 * grad[k]
                    square[k] = 0.99 * square[k] + 0.01 * grad[k] ** 2
                    move = rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
                    setattr(self, k, (getattr(self, k) - move).astype(np.float32))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text, the last one filled up with zeros, and the bytes in each."""
    n = max(1, -(-len(text) // WINDOW))
    padded = np.zeros(n * WINDOW, np.uint8)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    sizes = np.full(n, WINDOW, np.int64)
    sizes[-1] = len(text) - (n - 1) * WINDOW
    return padded.reshape(n, WINDOW), sizes


def held_out(ident: Column) -> Column:
    """A fifth of the ids, for tests. A null id is not held out."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, docs_per_language: int = 300, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", seed: int = 7, languages: int = 200) -> ByteNet | None:
    """A network trained on a bounded sample: about ``docs_per_language`` labelled texts that aren't held out of each of the
    ``languages`` most frequent labels, and of each text four stretches of at most a window. None where there are no such texts.

    Edge cases: rows with a null id, text or label, and texts without a letter, are not learned from; repeated rows count each, up to the bound;
    of very long texts four stretches are read; other columns are not read."""
    labelled = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("__text").rlike(r"\p{L}") & ~held_out(F.col("__id")))
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).withColumn("share", F.least(F.lit(1.0), F.lit(docs_per_language) / F.col("n")))
    chosen = labelled.join(F.broadcast(checkpointed(counts)), "lang").where(F.pmod(F.xxhash64("__id", F.lit(seed)), F.lit(1_000_000)) < F.col("share") * 1_000_000)
    spots = [F.substring(F.col("__text"), (F.floor(F.length("__text") * part) + 1).cast("int"), F.lit(WINDOW)) for part in (0.0, 0.3, 0.6, 0.9)]
    sample = chosen.select("lang", F.array(*spots).alias("spots")).limit(docs_per_language * languages * 2).collect()
    labels = sorted({r["lang"] for r in sample})
    if not labels:
        return None
    rng, x, y = np.random.default_rng(seed), [], []
    for r in sorted(sample, key=lambda r: (r["lang"], r["spots"])):
        for j, spot in enumerate(r["spots"]):
            raw = spot.encode()[:WINDOW]
            if j % 2:  # short ones too: texts of a few words, and last windows
                raw = raw[: int(rng.integers(12, WINDOW))].decode(errors="ignore").encode()
            if raw:
                x.append(windows_of(raw)[0][0])
                y.append(labels.index(r["lang"]))
    net = ByteNet.fresh(labels, seed)
    net.train(np.stack(x), np.array(y), seed=seed)
    return net


def predict(net: ByteNet | None, texts: list[str | None]) -> pd.DataFrame:
    """lang and score of each text that holds a letter."""
    lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if net is None or not texts:
        return pd.DataFrame({"lang_pred": lang, "score": score})
    total = np.zeros((len(texts), len(net.labels)))
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    waiting = 0

    def flush() -> None:
        x, sizes, owner = (np.concatenate(c) for c in zip(*held, strict=True))
        for i in range(0, len(x), BATCH):
            np.add.at(total, owner[i : i + BATCH], net.probabilities(x[i : i + BATCH]).astype(np.float64) * sizes[i : i + BATCH, None])
        held.clear()

    for i, text in enumerate(texts):
        if text:
            x, sizes = windows_of(text.encode())
            held.append((x, sizes, np.full(len(x), i)))
            waiting += len(x)
            if waiting > 4096:
                flush()
                waiting = 0
    if held:
        flush()
    for i in np.flatnonzero(total.sum(axis=1) > 0):
        best = int(total[i].argmax())
        lang[i], score[i] = net.labels[best], round(float(total[i, best] / total[i].sum()), 6)
    return pd.DataFrame({"lang_pred": lang, "score": score})


def language_of(text: Column, net: ByteNet | None) -> Column:
    """Struct of lang_pred and score; ``und`` and 0 for a null text, one without a letter, and without a network."""

    @F.pandas_udf("lang_pred string, score double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield predict(net, list(texts))

    return of(F.when(text.rlike(r"\p{L}"), text))


def identify(docs: DataFrame, net: ByteNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, held_out, lang_pred, score of every row of ``docs``.

    Edge cases: null, empty and letterless texts are ``und`` with score 0. Null ids aren't held out. Repeated rows stay; an
    empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), language_of(F.col(text_col), net).alias("found"))
    return rows.select(id_col, "held_out", "found.lang_pred", "found.score")
