"""Vector functions as Columns, over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import let

#: The hash has sixteen bytes; further components of its vector are 0.
HASH_BYTES = 16


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """Of length one; a zero vector stays."""
    scaled = lambda v, norm: F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))
    return let(v, lambda v: let(F.sqrt(dot(v, v)), lambda norm: scaled(v, norm)))


def md5_embedding(text: Column, dim: int) -> Column:
    """Offline vector: bytes of the text's MD5 from the last, over 255, scaled to length one."""
    byte = lambda digest, i: F.conv(F.substring(digest, 33 - 2 * (i + 1), 2), 16, 10).cast("double") / 255
    return l2_normalize(let(F.md5(text), lambda digest: F.array(*[byte(digest, i) if i < HASH_BYTES else F.lit(0.0) for i in range(dim)])))


def content_id(text: Column) -> Column:
    return F.concat(F.lit("chunk_"), F.left(F.sha2(text, 256), F.lit(16)))
