"""Cosine top-k over collections, with filters."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.vectors import dot

#: What stands between ``&&`` or commas; quotes hold both.
_PARTS = re.compile(r"""((?:'[^']*'|"[^"]*"|`[^`]*`|(?!&&).)+)(?:&&)?""", re.S)
_ITEMS = re.compile(r"""(?:'[^']*'|"[^"]*"|`[^`]*`|[^,])+""", re.S)
_CLAUSE = re.compile(r"\s*([\w.]+)\s*:\s*(:?=|>=|<=|>|<|!=)?\s*(.+?)\s*$", re.S)

#: Queries and rows whose products are in memory at once (rows doubled from the first to the last), and pairs scored exactly at a time.
QUERIES_AT_A_TIME, ROWS_AT_FIRST, ROWS_AT_MOST, SCORED = 256, 2048, 16384, 1 << 16


def _typed(value: str, kind: str | None) -> Column:
    """A literal of the column's own type, so that the test can be left to the scan; null where it has no such value."""
    if kind in (None, "string"):
        number = kind is None and re.fullmatch(r"-?\d+(\.\d+)?", value)
        return F.lit(float(value)) if number else F.lit(value)
    return F.lit(value).try_cast(kind)


def _unquoted(value: str) -> str:
    return value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "`'\"" else value


def _variant_test(col: Column, path: str, sign: str | None, value: str) -> Column:
    """The test of a value at a path of a variant, taken out as the kind that the value has; quotes make it text."""
    at = "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in path.split("."))
    found, schema = lambda kind: F.try_variant_get(col, at, kind), F.schema_of_variant(F.try_variant_get(col, at, "variant"))
    if re.fullmatch(r"-?\d+(\.\d+)?", value):
        number = schema.rlike(r"^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$")
        left, right = F.when(number, found("double")), F.lit(float(value))
        if "." not in value:  # whole numbers past a double's digits are told apart
            left, right = F.when(number, F.coalesce(F.when(schema == "BIGINT", found("decimal(38,18)")), found("double").try_cast("decimal(38,18)"))), F.lit(value).cast("decimal(38,18)")
    elif value in ("true", "false"):
        left, right = F.when(schema == "BOOLEAN", found("boolean")), F.lit(value == "true")
    else:
        left, right = F.when(schema == "STRING", found("string")), F.lit(_unquoted(value))
        if value.startswith("[") and value.endswith("]"):
            items = [v.strip() for v in _ITEMS.findall(value[1:-1]) if v.strip()]
            tests = [_variant_test(col, path, ":=", v) for v in items]
            return F.coalesce(F.array_max(F.array(*[F.coalesce(t, F.lit(False)) for t in tests])), F.lit(False)) if tests else F.lit(False)
        if sign is None:
            return F.lower(left).contains(_unquoted(value).lower())
    return {None: left == right, ":=": left == right, "=": left == right, ">": left > right, "<": left < right, ">=": left >= right, "<=": left <= right, "!=": left != right}[sign]


def parse_filter(expression: str, types: dict[str, str] | None = None) -> Column:
    """``field:=v``, ``field:v`` (contains), comparisons, ``field:[a, b]`` and ``metadata.key``, joined by ``&&`` outside quotes.

    ``types`` are the columns'. Values take the type of their column, and metadata that of the value. ``field.a.b`` is a path into a
    column of the type variant, whose value must be of the filter value's kind: a number (compared as such, whatever its digits),
    true or false, or text; anything else there, and what isn't there, is null."""
    out = F.lit(True)
    for part in _PARTS.findall(expression):
        if not (m := _CLAUSE.match(part)):
            raise ValueError(f"can't read the filter {part!r}")
        name, sign, value = m.groups()
        kind, number = (types or {}).get(name), re.fullmatch(r"-?\d+(\.\d+)?", value) is not None
        root, _, path = name.partition(".")
        if path and (types or {}).get(root) == "variant":
            out = out & _variant_test(F.col(root), path, sign, value)
            continue
        col = F.col("metadata")[name.split(".", 1)[1]] if name.startswith("metadata.") else F.col(name)
        if name.startswith("metadata."):
            col, kind = (col.try_cast("double"), "double") if number else (col, "string")
        is_array = (kind or "").startswith("array")
        if is_array:
            kind = kind[6:-1]
        if value.startswith("[") and value.endswith("]"):
            values = [_typed(_unquoted(v.strip()), kind) for v in _ITEMS.findall(value[1:-1]) if v.strip()]
            if kind is None:
                col, values = col.cast("string"), [F.lit(_unquoted(v.strip())) for v in _ITEMS.findall(value[1:-1]) if v.strip()]
            test = F.arrays_overlap(col, F.array(*values)) if is_array else col.isin(*values)
        elif is_array:
            test = F.array_contains(col, _typed(_unquoted(value), kind))
        elif sign is None and not number:
            test = F.lower(col.cast("string")).contains(_unquoted(value).lower())
        else:
            right = _typed(_unquoted(value), kind)
            test = {None: col == right, ":=": col == right, "=": col == right, ">": col > right, "<": col < right, ">=": col >= right, "<=": col <= right, "!=": col != right}[sign]
        out = out & test
    return out


def search(collection: DataFrame, vector: list[float], k: int = 10, filter_by: str | None = None, id_col: str = "id", score_mode: str = "similarity") -> DataFrame:
    """``k`` nearest rows by cosine with ``score`` (similarity, or its distance from 1), without their vectors; ties to the smaller id."""
    rows = collection.where(parse_filter(filter_by, dict(collection.dtypes))) if filter_by else collection
    query = F.array(*[F.lit(float(x)) for x in vector])
    norm = F.sqrt(dot(F.col("embedding"), F.col("embedding"))) * F.lit(float(np.linalg.norm(vector)))
    near = F.coalesce(F.try_divide(dot(query, F.col("embedding")), norm), F.lit(0.0))
    scored = rows.where(F.size("embedding") == len(vector)).withColumn("__near", F.round(near, 6)) if vector else rows.limit(0).withColumn("__near", F.lit(0.0))
    top = scored.drop("embedding").orderBy(F.desc("__near"), id_col).limit(k)
    return top.withColumn("score", F.col("__near") if score_mode == "similarity" else F.round(1 - F.col("__near"), 6)).drop("__near")


def _first(i: np.ndarray, j: np.ndarray, s: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best (query, row, score) of each query, ties to the smaller place."""
    order = np.lexsort((place[j], -s, i))
    i, j, s = i[order], j[order], s[order]
    start = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1]))) if len(i) else np.empty(0, np.int64)
    keep = np.arange(len(i)) - np.repeat(start, np.diff(np.append(start, len(i)))) < k
    return i[keep], j[keep], s[keep]


def nearest(q: np.ndarray, x: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the ``k`` best rows of ``x`` for each of ``q`` (unit vectors), by products to six places, ties to the
    smaller ``place``. Products of single precision, whose error is bounded, leave out rows that are surely below the k-th best so far;
    all others are scored in double precision. Products that aren't numbers are no results."""
    live = (q != 0).any(axis=0) & (x != 0).any(axis=0)  # what is zero on a side adds nothing
    q32, x32 = q[:, live].astype(np.float32), x[:, live].astype(np.float32)
    # Twice the error of a sum of products of unit vectors, and what six places round away at both ends.
    slack = 4 * (q32.shape[1] + 4) * float(np.finfo(np.float32).eps) + 2e-6
    out = []
    for at in range(0, len(q), QUERIES_AT_A_TIME):
        some, found = q32[at : at + QUERIES_AT_A_TIME], None
        least, low, size = np.full(len(some), -np.inf), 0, ROWS_AT_FIRST
        while low < len(x):
            near = some @ x32[low : low + size].T
            if found is None:
                n = min(k, near.shape[1])
                least = np.partition(np.where(np.isnan(near), -np.inf, near), near.shape[1] - n, axis=1)[:, near.shape[1] - n] if n == k else least
            i, j = np.nonzero(near >= (least - slack).astype(np.float32)[:, None])
            exact = [np.einsum("ij,ij->i", q[at + i[c : c + SCORED]], x[low + j[c : c + SCORED]]) for c in range(0, len(i), SCORED)]
            new = (i, j + low, np.round(np.concatenate(exact), 6) if exact else np.empty(0))
            found = _first(*(new if found is None else tuple(np.concatenate(c) for c in zip(found, new, strict=True))), place, k)
            last = np.flatnonzero(np.bincount(found[0], minlength=len(some)) == k)  # those that have k
            ends = np.cumsum(np.bincount(found[0], minlength=len(some))) - 1
            least[last] = found[2][ends[last]]
            low, size = low + size, min(2 * size, ROWS_AT_MOST)
        out.append((found[0] + at, *found[1:]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _nearest(asking: DataFrame, rows: DataFrame, keys: list[str], k: int, row_kind: str, query_kind: str) -> DataFrame:
    """(q, i, s): the ``k`` best ``rows`` (i, embedding) of each of ``asking`` (q, embedding) within each group of ``keys``."""

    def best(ask: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        if ask.empty or part.empty:
            return pd.DataFrame({"q": ask["q"].iloc[:0], "i": part["i"].iloc[:0], "s": pd.Series(dtype="float64")})
        unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        q, x = (unit(np.stack(f["embedding"].to_numpy()).astype(float)) for f in (ask, part))
        ids, names = part["i"].to_numpy(), ask["q"].to_numpy()
        place = np.empty(len(ids), np.int64)
        place[part["i"].reset_index(drop=True).sort_values(kind="stable").index] = np.arange(len(ids))
        i, j, s = nearest(q, x, place, k)
        return pd.DataFrame({"q": names[i], "i": ids[j], "s": s})

    return asking.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(best, f"q {query_kind}, i {row_kind}, s double")


def search_many(collection: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "id", query_id: str = "query_id", block: int | None = None, row_block: int | None = None) -> DataFrame:
    """query_id, rank, ``id_col``, score: top ``k`` for every row of ``queries`` (query_id, embedding).

    Blocks of about ``block`` queries meet blocks of about ``row_block`` rows in tasks of their own; each pair of blocks gives the
    best k rows of its queries, which are merged. Nothing but the two counts comes to the driver. Where none is given a block is an
    eighth of its table, within bounds: each side is copied once for each block of the other, so blocks grow as long as memory allows."""
    kinds = dict(collection.dtypes)[id_col], dict(queries.dtypes)[query_id]
    asked, n = queries.count(), collection.count()
    block, row_block = block or max(2000, min(16384, asked // 8)), row_block or max(8192, min(65536, n // 8))
    query_blocks, row_blocks = max(1, -(-asked // block)), max(1, -(-n // row_block))
    deal = lambda c, blocks: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    # A row is dealt by its id and vector, so rows that share an id are not one group.
    side = lambda frame, name, out: frame.where(F.size("embedding") > 0).select(F.col(name).alias(out), "embedding", F.size("embedding").alias("dim"))
    asking = side(queries, query_id, "q").withColumn("query_block", deal(F.struct("q", "embedding"), query_blocks)).withColumn("row_block", every(row_blocks))
    rows = side(collection, id_col, "i").withColumn("row_block", deal(F.struct("i", "embedding"), row_blocks)).withColumn("query_block", every(query_blocks))

    out = _nearest(asking, rows, ["dim", "row_block", "query_block"], k, *kinds)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "i"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias(query_id), "rank", F.col("i").alias(id_col), F.col("s").alias("score"))


def search_texts(collection: DataFrame, questions: DataFrame, embed: Callable[[Column], Column], k: int = 10, text_col: str = "text", id_col: str = "id", query_id: str = "query_id") -> DataFrame:
    """query_id, rank, ``id_col``, score: ``search_many`` for a table of questions (query_id, text), each embedded by ``embed``. Null and
    blank questions have no result."""
    asked = questions.where(F.trim(F.col(text_col)) != "").select(query_id, embed(F.col(text_col)).alias("embedding"))
    return search_many(collection, asked, k, id_col, query_id)
