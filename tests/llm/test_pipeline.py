import math
import random
from collections import Counter

import cases
import corpus_pipeline
import numpy as np
import pytest
import test_models
import test_shards_mix
import test_tokens
from pyspark.sql import functions as F

from quillspark.llm import language_id, near_copies, quality, simhash


def test_run_equals_plain_stages(spark, sf_dir):
    """Each stage's rows against loops over what it was given, and the end of ``run`` against the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages, given = dict(corpus_pipeline.STAGES), docs.collect()
    ids = lambda rows: sorted(r.doc_id for r in rows)

    kept = stages["language_id"](spark, docs, sf_dir).collect()
    found = language_id.predict(language_id.fit(docs), [r.text for r in given])
    letters = [any(c.isalpha() for c in r.text or "") for r in given]
    assert ids(kept) == sorted(r.doc_id for r, ok, score in zip(given, letters, found["score"], strict=True) if ok and score >= corpus_pipeline.LANGUAGE_SCORE)

    docs, given = spark.createDataFrame(kept, docs.schema), kept
    kept = stages["quality"](spark, docs, sf_dir).collect()
    evidence = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    p = {r.doc_id: round(evidence.good(r.text), 9) for r in given}
    path_means = test_models.plain_posteriors([(r.doc_id, r.source, r.lang, p[r.doc_id]) for r in given])
    odds = lambda x: math.log(min(max(x, 1e-6), 1 - 1e-6) / (1 - min(max(x, 1e-6), 1 - 1e-6)))
    assert ids(kept) == sorted(i for i in p if odds(p[i]) - odds(evidence.prior) + odds(path_means[i][1]) >= 0)

    docs, given = spark.createDataFrame(kept, docs.schema), kept
    kept = stages["near_dedup"](spark, docs, sf_dir).collect()
    sets = {r.doc_id: set(near_copies.shingles(r.text, 5).tolist()) for r in given}
    top = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and top[a] != top[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((top[a], top[b]))
                top = {i: x if t == y else t for i, t in top.items()}
    assert ids(kept) == sorted(set(top.values()))

    docs, given = spark.createDataFrame(kept, docs.schema), kept
    kept = stages["mixing"](spark, docs, sf_dir).collect()
    times = test_shards_mix.plain_mix([(r.doc_id, r.text, r.source) for r in given], corpus_pipeline.MIX["target_entropy"], corpus_pipeline.MIX["max_repetition"])
    copies = Counter(r.doc_id for r in kept)
    assert all(math.floor(times[r.source] + 1e-9) <= copies[r.doc_id] <= math.floor(times[r.source] + 1e-9) + 1 for r in given) and set(copies) <= {r.doc_id for r in given}

    docs = spark.createDataFrame(kept, docs.schema)
    texts = {r.doc_id: r.text for r in kept}
    columns = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "offset")
    pieces = Counter(tuple(r[c] for c in columns[:5]) for r in corpus_pipeline.run(spark, sf_dir).collect())
    tokens = Counter()
    for (i, _, length, _, _), n in pieces.items():
        tokens[i] += length * n
    assert tokens == Counter({i: n * (len(test_tokens.encode(test_tokens.WORD, texts[i])) + 1) for i, n in copies.items()})
    assert stages["packing"](spark, docs, sf_dir).count() > 0


def test_a_mix_is_packed_in_its_order(spark, sf_dir, docs):
    rows = [(i, "w " * 400, None, "big" if i % 10 else "small", *[None] * 5) for i in range(1500)]
    kept = corpus_pipeline.mix_sources(spark, spark.createDataFrame(rows, docs.schema), sf_dir).withColumn("p", F.spark_partition_id()).collect()
    at, repeats = {}, 0
    for i, r in enumerate(kept):
        if r.doc_id in at:
            repeats += 1
            assert i - at[r.doc_id] > 1  # not side by side
        at[r.doc_id] = i
    assert repeats


def test_columns_of_stages_may_clash(spark, sf_dir, docs):
    odd = docs.select("*", F.lit(1).alias("__found"), F.lit("x").alias("__key"), F.lit(2).alias("component"), F.lit(3).alias("node"))
    for name in ("language_id", "near_dedup", "mixing"):
        assert dict(corpus_pipeline.STAGES)[name](spark, odd, sf_dir).columns == odd.columns


def template(n, seed=6, words=1400, places=66, variants=4):
    """Texts of one template: about 0.7 alike, with no shingle of their own."""
    rng = random.Random(seed)
    base, at = [f"w{i}" for i in range(words)], list(range(5, words, words // places))[:places]
    out = []
    for _ in range(n):
        text = list(base)
        for place in at:
            text[place] = f"v{place}x{rng.randrange(variants)}"
        out.append(" ".join(text))
    return out


def test_texts_of_a_template_make_few_pairs(spark):
    texts = template(300)
    texts += [f"{t} and a few words more" for t in texts[:20]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = frame.select(F.col("doc_id").cast("string").cast("binary").alias("node"), near_copies._sets(5)("text").alias("s")).select("node", "s.*")
    open_ = sets.select(F.lit(1).cast("long").alias("bucket"), "node", F.col("node").alias("component"), F.lit(len(texts)).cast("long").alias("members"))
    pairs = [tuple(sorted((int(r.a), int(r.b)))) for r in near_copies._met(open_, sets, 0.8).collect()]
    assert len(pairs) == len(set(pairs)) < 10 * len(texts)
    exact = [set(near_copies.shingles(t, 5).tolist()) for t in texts]
    alike = {(i, j) for j in range(len(texts)) for i in range(j) if len(exact[i] & exact[j]) >= 0.8 * len(exact[i] | exact[j])}
    assert alike <= set(pairs) and len(alike) >= 20
    kept = near_copies.near_copies(frame).where("keep").count()
    top = {i: i for i in range(len(texts))}
    for i, j in sorted(alike):
        low, high = sorted((top[i], top[j]))
        top = {k: low if t == high else t for k, t in top.items()}
    assert kept == len(set(top.values()))


@pytest.mark.parametrize("block", [3, 2048])
def test_blocks_meet_each_pair_once(spark, monkeypatch, block):
    monkeypatch.setattr(near_copies, "BLOCK_ROWS", block)
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(9000)}" for _ in range(60)) for _ in range(8)]
    texts = [" ".join([*t.split()[: 60 - i], *[f"e{i}x{k}" for k in range(i)]]) for t in texts for i in range(4)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = frame.select(F.col("doc_id").cast("string").cast("binary").alias("node"), near_copies._sets(5)("text").alias("s")).select("node", "s.*")
    open_ = sets.select(F.lit(1).cast("long").alias("bucket"), "node", F.col("node").alias("component"), F.lit(len(texts)).cast("long").alias("members"))
    open_ = open_.unionByName(open_.limit(1).withColumn("bucket", F.lit(2).cast("long")))
    pairs = [tuple(sorted((int(r.a), int(r.b)))) for r in near_copies._met(open_, sets, 0.8).collect()]
    assert len(pairs) == len(set(pairs)) and {(i, j) for i in range(32) for j in range(i, 32) if i < j and i // 4 == j // 4} <= set(pairs)


def test_bound_loses_no_pair():
    rng = np.random.default_rng(12)
    sets = []
    for n in (1, 2, 5, 200, 240, 256, 257, 300, 1000, 1030, 1290, 5000):
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        sets += [np.unique(base)] + [np.unique(np.concatenate((base[: n - int(n * part)], rng.integers(0, 1 << 63, int(n * part * rng.random()), dtype=np.uint64)))) for part in (0.05, 0.1, 0.15, 0.2, 0.3)]
    sets = [s for s in sets if len(s)]
    found = {tuple(sorted(p)) for i, j in near_copies.allowed_pairs(np.array([len(s) for s in sets]), [near_copies.bitmap(s) for s in sets], 0.8) for p in zip(i.tolist(), j.tolist(), strict=True)}
    exact = [set(s.tolist()) for s in sets]
    alike = {(i, j) for j in range(len(sets)) for i in range(j) if len(exact[i] & exact[j]) >= 0.8 * len(exact[i] | exact[j])}
    assert alike <= found and len(found) < 1.5 * len(alike) + 20


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, sf_dir, docs, empty, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, sf_dir)
    out.collect()
    assert name == "packing" or out.columns == docs.columns
    assert stage(spark, empty, sf_dir).count() == 0


def test_dedup_keeps_one_of_each_group(spark, sf_dir, docs):
    kept = corpus_pipeline.drop_near_duplicates(spark, docs.where("doc_id is not null"), sf_dir).collect()
    ids = sorted(r.doc_id for r in kept)
    assert ids == [0, 1, 5, 6, 7, 8, 9]
    assert len(cases.TEXTS) == 10


def jaccard(a, b, n=5):
    a, b = ({tuple(t.lower().split()[i : i + n]) for i in range(max(1, len(t.split()) - n + 1))} for t in (a, b))
    return len(a & b) / len(a | b)


def test_dedup_joins_all_of_similarity(spark, sf_dir, docs):
    rng = random.Random(3)
    texts = []
    for g in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(120)]
        for i in range(8):
            words = list(base)
            for at in rng.sample(range(120), rng.randrange(0, 5)):
                words[at] = f"x{g}_{i}_{at}"
            texts.append(" ".join(words))
    top = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                x, y = sorted((top[i], top[j]))
                top = [x if t == y else t for t in top]
    frame = spark.createDataFrame([(i, t, None, None, None, None, None, None, None) for i, t in enumerate(texts)], docs.schema)
    kept = corpus_pipeline.drop_near_duplicates(spark, frame, sf_dir).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(top))
    assert 12 <= len(set(top)) < len(texts)


def test_dedup_counts_rows_not_ids(spark, sf_dir, docs):
    one, two = "alpha beta gamma delta epsilon zeta", "one two three four five six seven"
    rows = [(1, one), (1, two), (2, two), (None, one), (None, "null id only here, five words"), (None, "null id only here, five words")]
    frame = spark.createDataFrame([(i, t, *[None] * 7) for i, t in rows], docs.schema)
    kept = corpus_pipeline.drop_near_duplicates(spark, frame, sf_dir).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(1, one), (1, two), (0, "null id only here, five words")])
    with pytest.raises(ValueError):
        near_copies.near_copies(frame, 0.4)


def test_dedup_finds_near_copies_by_fingerprints(spark, sf_dir, docs, monkeypatch):
    """Without any band the index of fingerprints joins what is within its bits; texts apart stay, and with one far copy too."""
    monkeypatch.setattr(near_copies, "bands", lambda hashes: [])
    rng = random.Random(8)
    bases = [[f"w{rng.randrange(9000)}" for _ in range(600)] for _ in range(6)]
    texts = [" ".join([*base[: 600 - cut], *[f"e{g}x{cut}"] * bool(cut)]) for g, base in enumerate(bases) for cut in range(3)]
    far = " ".join(w if i % 40 else f"far{i}" for i, w in enumerate(bases[0]))
    prints = [simhash.fingerprint(t, 5) for t in [*texts, far]]
    near = {(i, j) for j in range(len(texts)) for i in range(j) if (prints[i] ^ prints[j]).bit_count() <= 4}
    assert all((3 * g, 3 * g + 1) in near for g in range(6)) and all(i // 3 == j // 3 for i, j in near)
    top = list(range(len(texts) + 1))
    for i, j in sorted(near):
        x, y = sorted((top[i], top[j]))
        top = [x if t == y else t for t in top]
    assert (prints[-1] ^ prints[0]).bit_count() > 4
    frame = spark.createDataFrame([(i, t, *[None] * 7) for i, t in enumerate([*texts, far])], docs.schema)
    kept = corpus_pipeline.drop_near_duplicates(spark, frame, sf_dir).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(top)) and len(kept) < len(texts)
