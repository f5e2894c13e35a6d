"""Phrases against plain counting."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import phrases, queries

SCHEMA = "doc_id long, text string, lang string, phrase string, n int, w string"


def plain(rows, least=30, top=2000, most=4, cover=80):
    count, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            words = [w for w in re.split("[ \t]+", piece) if w]
            total[lang] += len(words)
            for n in range(1, most + 1):
                count[lang].update(" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
    out = set()
    for lang, f in count.items():
        kept = {p: a for p, a in f.items() if a >= least and " " in p}
        held = Counter()
        for p, a in kept.items():
            w = p.split(" ")
            for size in range(2, len(w)):
                for i in range(len(w) - size + 1):
                    held[q] = max(held[q := " ".join(w[i : i + size])], a)
        found = []
        for p, a in kept.items():
            w = p.split(" ")
            cut = min((2_000_000 * a // (f[" ".join(w[:k])] + f[" ".join(w[k:])]), k) for k in range(1, len(w)))
            if 100 * held[p] < cover * a:
                found.append((-cut[0], -a, p.encode(), f[" ".join(w[: cut[1]])], f[" ".join(w[cut[1] :])]))
        out |= {(lang, i, p.decode(), -a, x, y, total[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)}
    return out


def rows_of(df):
    got = [(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def made(n, seed=5, words=12, langs=("en", "fr", None)):
    rng = random.Random(seed)
    one = lambda: rng.choice(["The", "the", "é", "x-y", "Zeta"] + [f"w{i}" for i in range(words)])
    text = lambda: "".join(one() + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!?", " \x0b"]) for _ in range(rng.randrange(60)))
    return [(text() + "fixed phrase of four words here." * rng.randrange(2), rng.choice(langs)) for _ in range(n)]


@pytest.mark.parametrize(("bits", "batch"), [(24, 8_000_000), (3, 500), (18, 2000)])
def test_equals_plain_counting(spark, monkeypatch, bits, batch):
    monkeypatch.setattr(phrases, "BATCH_BYTES", batch)
    monkeypatch.setattr(phrases, "FAN_IN", 2)
    rows = made(400)
    df = spark.createDataFrame([(i, t, lang, "x", 1, "y") for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(5)
    got = rows_of(phrases.collocations(df, top=25, least=6, bits=bits))
    assert got == plain(rows, least=6, top=25) and len({r[0] for r in got}) == 3


def test_counts_past_a_byte(spark):
    rows = [("one two three four five. " * 40, "en")] * 10 + [("two three", "en")] * 300
    got = rows_of(phrases.collocations(spark.createDataFrame([(i, t, lang, "", 0, "") for i, (t, lang) in enumerate(rows)], SCHEMA), least=300))
    assert got == plain(rows, least=300) and got


def test_odd_rows(spark):
    rows = [(None, "en"), ("", None), (" \t ", "en"), ("...", "en"), ("a " * 5000, None), ("a a a", None), ("Ünïcode ☃ 𝒳 " * 40, "en"), ("only", "xx")]
    df = spark.createDataFrame([(None, t, lang, None, None, None) for t, lang in rows], SCHEMA)
    got = rows_of(phrases.collocations(df, least=30))
    assert got == plain(rows)
    assert ("und", 1, "a a a a", 4997, 4999, 4999, 5003, 999599) in got or {r[0] for r in got} == {"und", "en"}
    assert phrases.collocations(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        phrases.collocations(df, bits=2)


def test_pruning_leaves_little_and_nothing_that_counts():
    rng = np.random.default_rng(3)
    texts = [" ".join(f"r{i}" for i in rng.integers(0, 3000, 400)) + " known pair of words" for _ in range(50)]
    batch, bits, least = phrases.Batch("en", texts), 16, 30
    words = Counter(" ".join(texts).split())
    ids = {w: i for i, w in enumerate(batch.vocabulary)}
    frequent = np.zeros(1 << bits, bool)
    frequent[phrases.bucket(batch.hashes(1)[[int(np.flatnonzero(batch.at == ids[w.encode()])[0]) for w, c in words.items() if c >= least]], bits)] = True
    full = np.bincount(phrases.bucket(batch.hashes(2)[batch.whole(2)], bits), minlength=1 << bits) >= least
    may = batch.candidates(2, frequent, full, bits)
    counted, times, _ = batch.count(2, np.flatnonzero(may))
    exact = Counter(b for t in texts for b in zip(t.split(), t.split()[1:], strict=False))
    want = {" ".join(b): n for b, n in exact.items() if n >= least}
    found = dict(zip(counted, times.tolist(), strict=True))
    assert want.items() <= found.items() and "known pair" in found and len(found) < 0.01 * len(exact)


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.execute(queries.oracle_sql()["op13_phrases"]).df()
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = queries.op13_phrases(spark, sf_dir)
    assert dict(got.dtypes)["score"] == "bigint"
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want[columns].itertuples(index=False, name=None))
    assert rows_of(got) == plain([(r.text, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", F.col("lang")).collect()])
