"""Text functions as Columns. Positions are 0-based and half-open; white space, digits and letters are those of Unicode."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space, as ranges of a character class, and its characters.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
#: Results that a fold gathers before it sets them aside, so that no step copies all that came before.
BLOCK = 256


def wide(pattern: str) -> str:
    """A pattern whose classes ``\\s``, ``\\S`` and ``\\d`` are those of Unicode, as the engine's own are of ASCII."""
    return pattern.replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]").replace(r"\d", r"\p{Nd}")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body (and functions over arrays in it) uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_out(items: Column, zero: Column, step: Callable[[Column, Column], Column], carry: str, out: str, finish: Callable[[Column], Column]) -> Column:
    """What ``step`` gives out, in order, as it goes over ``items`` with a carried value, then what ``finish`` makes of its last one.

    ``step(carried, item)`` is a struct of the next ``carry`` (of that type) and ``out`` (an array of that type). Work and memory
    grow with the number of items, not its square."""
    one, block = f"struct<carry:{carry},out:array<{out}>>", f"struct<carry:{carry},out:array<array<{out}>>>"
    pair = lambda carried, given: F.struct(carried.alias("carry"), given.alias("out"))
    add = lambda s, x: let(step(s["carry"], x), lambda r: pair(r["carry"], F.concat(s["out"], r["out"])).cast(one))

    def over(items: Column) -> Column:
        def add_block(s: Column, start: Column) -> Column:
            inner = F.reduce(F.slice(items, start + 1, F.lit(BLOCK)), pair(s["carry"], F.array()).cast(one), add)
            return let(inner, lambda r: pair(r["carry"], F.concat(s["out"], F.array(r["out"]))).cast(block))

        starts = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1, F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
        return let(F.reduce(starts, pair(zero, F.array()).cast(block), add_block), lambda r: F.concat(F.flatten(r["out"]), finish(r["carry"]).cast(f"array<{out}>")))

    return let(items, over)


def emit(carried: Column, *out: Column) -> Column:
    """A step of ``fold_out`` that gives out some values."""
    return F.struct(carried.alias("carry"), F.array(*out).alias("out"))


def with_starts(pieces: Column) -> Column:
    """Structs of each text and the characters before it."""
    kind = "struct<text:string,start:int>"
    return fold_out(pieces, F.lit(0), lambda at, p: emit(at + F.length(p), F.struct(p.alias("text"), at.alias("start")).cast(kind)), "int", kind, lambda at: F.array())


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(SPACES))


def clean_text(text: Column, semantics: str = "observed") -> Column:
    """Lines stripped; blank ones dropped (observed), or runs of them made one (documented)."""
    lines = F.transform(F.split(text, "\n"), strip)
    if semantics == "observed":
        return F.array_join(F.filter(lines, lambda l: l != ""), "\n")
    return strip(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def words(text: Column) -> Column:
    return F.filter(F.split(text, wide(r"\s+")), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def sentences(text: Column, semantics: str = "observed") -> Column:
    """The whole text as one (observed), or parts that end with a stop before a capital (documented)."""
    if semantics == "observed":
        return F.array(strip(text))
    return F.transform(F.split(text, wide("(?<=[.!?][\"'»]?)\\s+(?=[A-Z])")), strip)


def paragraphs(text: Column, pattern: str = "\n\n") -> Column:
    return F.filter(F.transform(F.split(text, pattern), strip), lambda p: p != "")


def pack(parts: Column, most: int, joiner: str = "\n\n", overlap: int = 0, count_joiners: bool = True) -> Column:
    """Array of texts: ``parts`` laid together in order while they stay within ``most`` characters. A new text begins with the
    last ``overlap`` characters of the one before. A single part may be longer than ``most``."""

    def add(s: Column, part: Column) -> Column:
        full = (s["size"] + F.length(part) > most) & (s["now"] != "")
        carried = F.concat(F.right(s["now"], F.lit(overlap)), F.lit(joiner), part) if overlap else part
        joined = F.when(s["now"] == "", part).otherwise(F.concat(s["now"], F.lit(joiner), part))

        def next_(now: Column) -> Column:
            size = F.length(now) if count_joiners else F.when(full, F.length(part)).otherwise(s["size"] + F.length(part))
            out = F.when(full, F.array(s["now"])).otherwise(F.array().cast("array<string>"))
            return F.struct(F.struct(now.alias("now"), size.alias("size")).alias("carry"), out.alias("out"))

        return let(F.when(full, carried).otherwise(joined), next_)

    zero = F.struct(F.lit("").alias("now"), F.lit(0).alias("size"))
    return fold_out(parts, zero, add, "struct<now:string,size:int>", "string", lambda s: F.filter(F.array(s["now"]), lambda t: t != ""))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Shared members over the smaller array's; null where one is empty."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.least(F.size(a), F.size(b)), F.lit(0))
