import math
from collections import Counter, defaultdict
from itertools import groupby

from pyspark.sql import functions as F

import numpy as np
import pytest

from quillspark.llm import histogram_sort
from quillspark.llm.histogram_sort import find_splitters, shard_by_bytes
from quillspark.llm.mixing import mixture, temperature_mix


def shards_of(df, **more):
    rows = shard_by_bytes(df, **more).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return rows


def test_shards_are_even_with_copies_and_a_hot_text(spark):
    data = [(i, f"text {i} " * (i % 50 + 1)) for i in range(4000)] + [(10_000 + i, "the same words") for i in range(3000)]
    rows = shards_of(spark.createDataFrame(data, "doc_id long, text string"), shards=8, rows_per_part=200)
    total, by = sum(r["size"] for r in rows), Counter()
    for r in rows:
        by[r.shard] += r["size"]
    assert len(rows) == 7000 and len(by) == 8 and all(abs(b - total / 8) <= 2 * max(0.001 * total / 8, 250) for b in by.values())


def hot_rows(spark, n, copies, partitions):
    """A third of the rows have one text."""
    made = spark.range(n, numPartitions=partitions).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.repeat(F.lit("hot words "), F.lit(12))).otherwise(F.concat(F.lit("text "), F.col("id").cast("string"), F.repeat(F.lit(" and on"), (F.col("id") % 40).cast("int")))).alias("text"))
    return made if copies else made.where("doc_id % 3 <> 0")


def test_few_rounds_for_a_hot_text_over_many_partitions(spark, monkeypatch):
    rounds, count = [], histogram_sort.count_between
    monkeypatch.setattr(histogram_sort, "count_between", lambda *a: rounds.append(a[1]) or count(*a))
    rows = shards_of(hot_rows(spark, 12_000, True, 211), shards=8)
    by = Counter()
    for r in rows:
        by[r.shard] += r["size"]
    total = sum(by.values())
    assert len(rounds) <= 5 and len(rows) == 12_000 and len(by) == 8
    # An edge lies within 0.1 % of a shard of its target, or within half a row, so a shard within twice that of the mean.
    assert all(abs(b - total / 8) <= 2 * max(0.001 * total / 8, 400) for b in by.values())


@pytest.mark.parametrize("copies", [True, False])
def test_splitters_equal_sorted_sums(spark, copies):
    docs = hot_rows(spark, 6000, copies, 7)
    keyed = docs.select((F.octet_length("text") + 1).cast("long").alias("size"), histogram_sort.sort_key(F.col("text"), F.col("doc_id")).alias("key"))
    both = sorted((r["key"], r["size"]) for r in keyed.collect())
    keys, upto = np.array([k for k, _ in both]), np.concatenate(([0], np.cumsum([s for _, s in both])))
    total, shards, tolerance = int(upto[-1]), 8, 0.001
    cells, edges, parts = find_splitters(keyed, len(both), total, shards, tolerance, 500)
    assert (cells.start.tolist() == sorted(set(cells.start.tolist()))) and cells.rows.sum() == len(both) and cells.size.sum() == total
    for i, edge in enumerate(edges):
        before = int(np.searchsorted(keys, cells.start[edge]))  # rows below the splitter, by sorting
        assert before == cells.below(cells.rows)[edge] and upto[before] == cells.below(cells.size)[edge]
        target = total * (i + 1) / shards
        nearest = np.abs(upto - target).min()
        assert abs(upto[before] - target) <= max(tolerance * total / shards, nearest)
    for i, edge in enumerate(parts):
        assert abs(cells.below(cells.rows)[edge] - 500 * (i + 1)) <= 125


def test_many_small_rows_of_one_text_are_several_parts(spark):
    frame = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 > 0, F.repeat(F.lit("long "), (F.col("id") % 900).cast("int"))).alias("text"))
    out = shard_by_bytes(frame, rows_per_part=100)
    parts = [r["count"] for r in out.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()]
    assert sum(parts) == 3000 and max(parts) <= 150 + 1
    slots = defaultdict(list)
    for r in out.collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_fewer_rows_than_shards(spark):
    rows = shards_of(spark.createDataFrame([(1, "only one"), (2, None)], "doc_id long, text string"))
    assert len(rows) == 2 and all(0 <= r.shard < 8 for r in rows)


def test_shard_edges(docs, empty):
    rows = shards_of(docs)
    assert len(rows) == docs.count() and {r.law for r in rows} == {"bytes"}
    null = next(r for r in rows if r.doc_id == 2)
    assert (null["size"], null.text_crc32, null.grown_shard) == (1, 0, None)
    assert shard_by_bytes(empty).count() == 0


def test_mixture_meets_entropy_and_repetition(spark):
    sources = spark.createDataFrame([("a", 1_000_000), ("b", 10_000), ("c", 2000), ("z", 0)], "source string, tokens long")
    flat = mixture(sources, 0.9, 1e9).collect()
    w = [r.weight for r in flat if r.weight > 0]
    assert abs(sum(w) - 1) < 1e-9 and abs(-sum(x * math.log(x) for x in w) / math.log(3) - 0.9) < 1e-6
    limited = mixture(sources, 0.9, 4.0).collect()
    assert max(r.repetitions for r in limited) <= 4.0 + 1e-6
    assert {r.source: r.weight for r in limited}["z"] == 0.0


def test_mix_realises_the_weights(spark):
    df = spark.createDataFrame([(i, "w " * 100, "big" if i % 20 else "small") for i in range(4000)], "doc_id long, text string, source string")
    rows = temperature_mix(df, 0.95, 3.0, block_tokens=5000).select("doc_id", "source", "__mix.*").collect()
    assert abs(len(rows) - 4000) <= 0.03 * 4000
    for source in ("big", "small"):
        mine = [r for r in rows if r.source == source]
        assert abs(sum(r.tokens for r in mine) / 400_000 - mine[0].weight) < 0.02
        copies = Counter(r.doc_id for r in mine)
        assert max(copies.values()) <= int(mine[0].repetitions) + 1


def plain_mix(rows, entropy, limit, budget=None):
    """source: repetitions, by halving the exponent over a list."""
    tokens = Counter()
    for _, text, source in rows:
        tokens[source] += len((text or "").split())
    p = {s: n / sum(tokens.values()) for s, n in tokens.items() if n}
    times = 1 if budget is None else budget / sum(tokens.values())
    weights = lambda a: {s: x**a / sum(y**a for y in p.values()) for s, x in p.items()}
    roots = []
    for holds in (lambda w: -sum(x * math.log(x) for x in w.values()) >= entropy * math.log(len(p)), lambda w: max(w[s] / p[s] for s in p) * times > limit):
        low, high = 0.0, 1.0
        for _ in range(49):
            low, high = ((low + high) / 2, high) if holds(weights((low + high) / 2)) else (low, (low + high) / 2)
        roots.append(low)
    w = weights(round(max(roots), 9))
    return {s: w[s] / p[s] * times for s in p}


@pytest.mark.parametrize("budget", [None, 90_000])
def test_mix_equals_a_plain_one(spark, budget):
    data = [(i, "w " * (i % 37), "big" if i % 10 else ("small", "tiny")[i % 4 == 0]) for i in range(3000)]
    rows = temperature_mix(spark.createDataFrame(data, "doc_id long, text string, source string"), 0.8, 3.0, block_tokens=3000, budget_tokens=budget).select("doc_id", "source", "__mix.*").collect()
    want = plain_mix(data, 0.8, 3.0, budget)
    copies, texts = Counter(r.doc_id for r in rows), {i: t for i, t, _ in data}
    for source, times in want.items():
        mine = [i for i, _, s in data if s == source]
        whole = math.floor(times + 1e-9)
        assert all(copies[i] in ((whole, whole + 1) if texts[i] else (whole,)) for i in mine)
        blocks = {r.doc_id: r.block for r in rows if r.source == source}
        total, taken, largest = Counter(), Counter(), 0
        for i in mine:
            n = len(texts[i].split())
            largest = max(largest, n)
            if i in blocks:
                total[blocks[i]] += n
                taken[blocks[i]] += n * (copies[i] - whole)
        if whole:  # every document is there, so a block's tokens are known
            assert all(abs(taken[b] - (times - whole) * total[b]) <= largest for b in total)
        assert next(r.repetitions for r in rows if r.source == source) == pytest.approx(times, rel=1e-6)
    got = sum(len(texts[r.doc_id].split()) for r in rows)
    every = sum(len(t.split()) for t in texts.values())
    assert abs(got - (budget or every)) <= 0.03 * every


def test_mix_is_a_permutation_of_blocks(spark):
    data = [(i, "w " * 50, "big" if i % 10 else "small") for i in range(2000)]
    mixed = temperature_mix(spark.createDataFrame(data, "doc_id long, text string, source string"), 1.0, 20.0, block_tokens=2000)
    rows = sorted(mixed.select("doc_id", "source", "__mix.*").collect(), key=lambda r: (r.block_order, r.order))
    groups = [k for k, _ in groupby((r.source, r.copy, r.block) for r in rows)]
    assert len(groups) == len(set(groups)) > 20  # a copy of a block is one run
    places = defaultdict(list)
    for i, (source, *_) in enumerate(groups):
        places[source].append(i / len(groups))
    assert all(0.3 < sum(x) / len(x) < 0.7 for x in places.values())  # sources are spread over the whole order
    at = defaultdict(list)
    for i, r in enumerate(rows):
        at[r.doc_id].append(i)
    repeated = [b - a for x in at.values() for a, b in zip(x, x[1:], strict=False)]
    assert repeated and min(repeated) > 1  # copies of a document are in blocks apart


def test_mix_sums_any_number_of_sources(spark):
    sources = spark.range(5000).select(F.col("id").cast("string").alias("source"), (F.col("id") % 97 * F.col("id")).alias("tokens"))
    found = mixture(sources, 0.97, 50.0).collect()
    w = [r.weight for r in found if r.weight > 0]
    assert abs(sum(w) - 1) < 1e-9 and abs(-sum(x * math.log(x) for x in w) / math.log(len(w)) - 0.97) < 1e-6


def test_rows_without_ids_or_texts_are_many_blocks(spark):
    frame = spark.range(3000, numPartitions=5).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit("s").alias("source"))
    out = temperature_mix(frame, block_rows=100)
    sizes = [r["count"] for r in out.groupBy("__mix.block").count().collect()]
    assert sum(sizes) == 3000 and len(sizes) == 30 and max(sizes) < 160


def test_mix_edges(docs, empty):
    out = temperature_mix(docs)
    assert out.columns == [*docs.columns, "__mix"] and temperature_mix(empty).count() == 0
    textless = docs.where("text is null")
    assert temperature_mix(textless).count() == textless.count()
    assert {r[0] for r in out.select("source").distinct().collect()} >= {None}


def test_mix_is_the_same_again(docs):
    one, two = (sorted(map(str, temperature_mix(docs).select("doc_id", F.col("__mix.order")).collect())) for _ in range(2))
    assert one == two
