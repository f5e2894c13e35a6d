"""Temperature mixing of sources, with DataFrame functions only.

A source with token share p gets the weight p**a / sum(p**a). The exponent a is bisected: the largest in [0, 1] whose weights
reach the target entropy, raised where some source would repeat more often than allowed. Weights times the token budget give
each source's repetitions r: floor(r) whole passes and, for the rest, a part of every block of the source. Each pass of each
block has a place in one random permutation of all sources' blocks, and the block's documents a random order within it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import checkpointed, join_stats

#: Words, as token counts see them where no count is given.
WORDS = r"[^\x20\x09-\x0D]+"
#: A job sums for all exponents that so many halvings can come to; there are as many jobs.
HALVINGS, ROUNDS = 7, 7
BISECTIONS = HALVINGS * ROUNDS
#: Sources that a task sums at least.
SUMMED = 100_000


def _bisected(shares: DataFrame, tests: list[Callable[[float, float, float], bool]]) -> list[float]:
    """For each test of (a, sum of p**a, sum of p**a * ln p), which holds below some exponent and not above: that exponent.

    The sums are taken where the shares are; two numbers for each exponent of a round come back."""
    spans, steps = [(0.0, 1.0)] * len(tests), 2**HALVINGS
    for _ in range(ROUNDS):
        tried = [[low + (high - low) * i / steps for i in range(steps + 1)] for low, high in spans]
        asked = sorted({a for points in tried for a in points[1:-1]})
        power = F.pow("p", F.col("a"))
        got = shares.select("p", F.explode(F.array(*map(F.lit, asked))).alias("a")).groupBy("a").agg(F.sum(power).alias("z"), F.sum(power * F.ln("p")).alias("s")).collect()
        sums = {r["a"]: (r["z"], r["s"]) for r in got}
        for k, (points, holds) in enumerate(zip(tried, tests, strict=True)):
            low, high = 0, steps
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if holds(points[middle], *sums[points[middle]]) else (low, middle)
            spans[k] = points[low], points[high]
    return [low for low, _ in spans]


def mixture(sources: DataFrame, target_entropy: float, max_repetition: float, budget_tokens: int | None = None) -> DataFrame:
    """``sources`` (source, tokens and more) with share, exponent, weight and repetitions; the budget is all tokens if not given.

    ``target_entropy`` is a part (0 to 1) of the entropy of equal shares. A budget of more than ``max_repetition`` times all tokens
    can't keep that limit; it then has the shares themselves as weights. Sources without tokens have the weight 0. ``sources``
    is read once a round and should be a checkpoint."""
    shares = sources.where("tokens > 0").select(F.col("tokens").cast("double").alias("tokens"))
    total, n, least = shares.agg(F.sum("tokens"), F.count("*"), F.min("tokens")).first()
    exponent, z, times = 0.0, 1.0, 1.0
    if n:
        shares = shares.select((F.col("tokens") / F.lit(total)).alias("p"))
        times = (total if budget_tokens is None else budget_tokens) / total
        # With w = p**a / z, entropy is ln z - a * sum(p**a ln p) / z, and the most repeated source has w / p, p the smallest share.
        # Entropy falls as the exponent grows and so does the highest repetition: each condition holds below its root.
        flat = lambda a, z, s: math.log(z) - a * s / z >= target_entropy * math.log(n)
        rare = lambda a, z, s: (least / total) ** (a - 1) / z * times > max_repetition
        exponent = round(max(_bisected(shares, [flat, rare])), 9)
        (z,) = shares.agg(F.sum(F.pow("p", F.lit(exponent)))).first()
    share = F.col("tokens") / F.lit(total or 1.0)
    weight = F.when(F.col("tokens") > 0, F.pow(share, F.lit(exponent)) / F.lit(z)).otherwise(F.lit(0.0))
    return sources.withColumns({"share": share, "exponent": F.lit(exponent), "weight": weight, "repetitions": F.when(F.col("tokens") > 0, weight / share * F.lit(times)).otherwise(F.lit(0.0))})


def temperature_mix(
    docs: DataFrame, target_entropy: float = 0.95, max_repetition: float = 4.0, block_tokens: int = 200_000, block_rows: int = 100_000, budget_tokens: int | None = None,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", tokens_col: str | None = None, seed: str = "mix",
) -> DataFrame:
    """All columns of ``docs`` for the chosen documents, once for each copy, with __mix: a struct of tokens, share, weight,
    repetitions, copy (from 0), block, block_order and order. Read by (block_order, order), it is the mix: block_order is the
    place of a copy of a block in the permutation of all sources' blocks, order that of a document in it; both are random strings.

    ``budget_tokens`` is what the mix is to have in all, as many as there are if None. A document's tokens are ``tokens_col`` or
    else its words. Documents are dealt to blocks of about ``block_tokens`` tokens and at most about ``block_rows`` rows by a hash of
    id and text, so a hot source is many independent groups. In a block, read in random order, the part r - floor(r) of its
    tokens is taken once more than floor(r) times: a document is in it if its middle is below that mark.

    Edge cases: null sources are one source; null and empty texts have no tokens and are in the mix floor(r) times, or once
    where their source has no tokens at all, since they cost no budget. Null ids are told apart by their places in the table.
    Repeated rows stay rows of their own; those that share id and text have the same order, and ties are broken by nothing else,
    so equal rows count as one in the running sum. Column names of ``docs`` may be any but those that begin with ``__mix``. An
    empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    count = F.coalesce(F.col(tokens_col), F.lit(0)) if tokens_col else F.regexp_count(text, F.lit(WORDS))
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n"))
    ident = F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("row "), F.monotonically_increasing_id())), F.lit(seed), F.md5(text))
    rows = docs.withColumns({"__mix_key": key, "__mix_tokens": count.cast("long"), "__mix_order": F.md5(ident)})
    totals = checkpointed(rows.groupBy(F.col("__mix_key").alias("source")).agg(F.sum("__mix_tokens").alias("tokens"), F.count("*").alias("rows")))
    known = totals.coalesce(-(-max(totals.count(), 1) // SUMMED))
    stats = checkpointed(mixture(known, target_entropy, max_repetition, budget_tokens).select(F.col("source").alias("__mix_key"), F.struct("tokens", "rows", "share", "exponent", "weight", "repetitions").alias("__mix_of")))
    rows = join_stats(rows, stats, ["__mix_key"], F.col("__mix_order"))
    blocks = F.greatest(F.ceil(F.col("__mix_of.tokens") / F.lit(block_tokens)), F.ceil(F.col("__mix_of.rows") / F.lit(block_rows)), F.lit(1)).cast("long")
    # Eight hex digits of the order deal the block; the rest of it orders the block.
    rows = rows.withColumn("__mix_block", F.pmod(F.conv(F.substring("__mix_order", 1, 8), 16, 10).cast("long"), blocks))
    within = Window.partitionBy("__mix_key", "__mix_block")
    upto = within.orderBy("__mix_order").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"__mix_upto": F.sum("__mix_tokens").over(upto), "__mix_all": F.sum("__mix_tokens").over(within)})
    whole = F.floor(F.col("__mix_of.repetitions") + F.lit(1e-9)).cast("long")
    part = F.greatest(F.col("__mix_of.repetitions") - whole, F.lit(0.0))
    more = (F.col("__mix_upto") - F.col("__mix_tokens") / 2 < part * F.col("__mix_all")) & (F.col("__mix_tokens") > 0)
    copies = F.when(F.col("__mix_of.tokens") > 0, whole + F.when(more, 1).otherwise(0)).otherwise(F.lit(1))
    out = rows.withColumn("__mix_copies", copies.cast("int")).where(F.col("__mix_copies") > 0)
    out = out.withColumn("__mix_copy", F.explode(F.sequence(F.lit(0), F.col("__mix_copies") - 1)))
    copy = F.col("__mix_copy").cast("string")
    detail = F.struct(
        F.col("__mix_tokens").alias("tokens"), F.col("__mix_of.share").alias("share"), F.col("__mix_of.weight").alias("weight"), F.col("__mix_of.repetitions").alias("repetitions"), F.col("__mix_copy").alias("copy"), F.col("__mix_block").alias("block"),
        F.md5(F.concat_ws("|", copy, F.col("__mix_block").cast("string"), F.lit(seed), "__mix_key")).alias("block_order"), F.md5(F.concat_ws("|", copy, "__mix_order")).alias("order"),
    )
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], detail.alias("__mix"))


def in_order(mixed: DataFrame) -> DataFrame:
    """What ``temperature_mix`` gives without __mix: blocks whole and in the order of their permutation within each partition, and so in
    each file that is written of it. Partitions themselves are in no order.

    Edge cases: repeated rows stay; an empty table gives no rows; columns have any names but those that begin with ``__mix``."""
    return mixed.repartition(F.col("__mix.block_order")).sortWithinPartitions("__mix.block_order", "__mix.order").drop("__mix")
