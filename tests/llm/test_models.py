"""Language identification and quality: held-out accuracy, formulas, edges."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import language_id, quality, url_filter
from quillspark.llm.queries import op4_language_id, op6_quality


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = op4_language_id(spark, sf).join(truth, "doc_id").where("held_out and lang is not null")
    right, n = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 100 and right / n >= 0.95


def test_labels_of_held_out_rows_teach_nothing(spark):
    df = spark.createDataFrame([(i, f"word number {i} in some text", "en" if i % 2 else "fr") for i in range(200)], "doc_id long, text string, lang string")
    other = df.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    a, b = language_id.fit(df), language_id.fit(other)
    assert a.labels == b.labels and (a.out == b.out).all()


def test_language_edges(docs, empty):
    net = language_id.fit(docs)
    got = language_id.identify(docs, net).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].lang_pred for i in (1, 2, 3, 6)] == ["und"] * 4 and by_id[0].lang_pred == "en"
    assert not any(r.held_out for r in got if r.doc_id is None)
    assert language_id.identify(empty, language_id.fit(empty)).count() == 0
    assert language_id.predict(None, ["x"]).lang_pred[0] == "und"


def test_whole_text_counts(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    net = language_id.fit(docs)
    sample = {r.lang: r.t for r in docs.where("lang is not null").groupBy("lang").agg(F.max_by("text", "n_chars").alias("t")).collect()}
    (a, first), (b, rest) = list(sample.items())[:2]
    assert language_id.predict(net, [first[:600] + rest * 20]).lang_pred[0] == b


def test_quality_separates_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = op6_quality(spark, sf).join(labels, "doc_id").withColumn("good", (F.col("quality") == 1) & (F.col("toxic") == 0))
    right, n = got.agg(F.count_if(F.col("keep") == F.col("good")), F.count("*")).first()
    assert right / n >= 0.95


def plain_posteriors(rows):
    """(doc_id, host, path, p) -> doc_id: (host_mean, path_mean), by loops."""
    hosts, paths = {}, {}
    for _, h, s, p in rows:
        hosts.setdefault(h, []).append(p)
        paths.setdefault((h, s), []).append(p)
    n = len(rows)
    prior = (sum(p for *_, p in rows) + 1) / (n + 2)
    mean = lambda xs: sum(xs) / len(xs)
    between = (sum(len(x) * (mean(x) - prior) ** 2 for x in hosts.values()) - (len(hosts) - 1) * prior * (1 - prior)) / (n - sum(len(x) ** 2 for x in hosts.values()) / n)
    clip = lambda s: min(max(s, 1.0), 1000.0)
    strength = clip(prior * (1 - prior) / between - 1) if between > 0 else 1000.0
    of_host = {h: (sum(x) + strength * prior) / (len(x) + strength) for h, x in hosts.items()}
    inner = sum(len(x) * mean(x) * (1 - mean(x)) for x in hosts.values()) / n
    spread = sum(len(x) * (mean(x) - mean(hosts[h])) ** 2 for (h, _), x in paths.items())
    apart = (spread - (len(paths) - len(hosts)) * inner) / max(n - sum(len(x) ** 2 / len(hosts[h]) for (h, _), x in paths.items()), 1e-9)
    weight = clip(inner / apart - 1) if apart > 0 else 1000.0
    return {i: (of_host[h], (sum(paths[h, s]) - p + weight * of_host[h]) / (len(paths[h, s]) - 1 + weight)) for i, h, s, p in rows}


def test_posteriors_of_sparse_sites_equal_plain_loops(spark):
    evidence = quality.fit_evidence([("fine words here", 1)] * 10 + [("bad spam spam", 0)] * 10)
    good = lambda i: not (i % 5 == 0 and i < 100) and i % 7 > 0
    url = lambda i: f"https://h{i % 4}.org/{'ab'[i % 2]}/{i}" if i < 120 else f"http://rare{i}.com/x/{i}"  # noqa: E731  the rest are sites of one page
    data = [(i, "fine words here" if good(i) else "bad spam spam", url(i)) for i in range(150)] + [(200, None, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, url string")
    host, path = url_filter.host_of(F.col("url")), F.regexp_extract(url_filter.path_of(F.col("url")), "^/[^/]*/", 0)
    rows = quality.score_quality(df, evidence, host, path).select("*", "__q.*").collect()
    p = {r.doc_id: round(evidence.good(r.text), 9) for r in rows}
    site = lambda u: (u.split("/")[2], "/" + u.split("/")[3] + "/") if u else ("", "")
    want = plain_posteriors([(i, *site(u), p[i]) for i, _, u in data])
    odds = lambda x: math.log(min(max(x, 1e-6), 1 - 1e-6) / (1 - min(max(x, 1e-6), 1 - 1e-6)))
    assert len(rows) == len(data)
    for r in rows:
        of_host, of_path = want[r.doc_id]
        assert r.host_mean == pytest.approx(of_host, abs=2e-6) and r.path_mean == pytest.approx(of_path, abs=2e-6)
        score = 1 / (1 + math.exp(-(odds(p[r.doc_id]) - odds(evidence.prior) + odds(of_path))))
        assert r.score == pytest.approx(score, abs=1e-4) and r.keep == (score >= 0.5)
    overall = (sum(p.values()) + 1) / (len(p) + 2)
    # One page tells little: its site's mean is nearer the global one than the page's own probability.
    assert all(abs(r.host_mean - overall) < abs(p[r.doc_id] - overall) for r in rows if r.url and "rare" in r.url)


def test_quality_tells_labels_it_was_not_fitted_on(spark):
    sf = "/root/testdata/sf0.1"
    labels, docs = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    evidence = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    other = docs.join(labels.where("doc_id % 2 = 1 AND doc_id % 3 = 0"), "doc_id").select("quality", "toxic", quality.evidence_of(F.col("text"), evidence).alias("p")).collect()
    right = sum((r.p >= 0.5) == (r.quality == 1 and r.toxic == 0) for r in other)
    assert len(other) > 300 and right / len(other) >= 0.95


def test_texts_are_scored_once(spark, docs):
    scored = quality.score_quality(docs, None, F.col("source"), F.col("lang"))
    assert "Python" not in scored._jdf.queryExecution().optimizedPlan().toString()


def plain_probabilities(net, window):
    places = len(window) - max(language_id.WIDTHS) + 1
    hidden = []
    for f in range(net.kernel.shape[1]):
        width, at = language_id.WIDTHS[f // language_id.FILTERS], language_id.DIM
        response = [sum(float(net.embed[window[i + j]] @ net.kernel[j * at : (j + 1) * at, f]) for j in range(width)) for i in range(places)]
        hidden.append(max(max(response) + float(net.bias[f]), 0))
    out = [sum(h * float(net.out[i, c]) for i, h in enumerate(hidden)) + float(net.out_bias[c]) for c in range(len(net.labels))]
    e = [math.exp(x - max(out)) for x in out]
    return [x / sum(e) for x in e]


def test_network_equals_plain_loops():
    rng = np.random.default_rng(4)
    net = language_id.ByteNet.fresh(["a", "b", "c"], 3)
    windows = rng.integers(0, 256, (3, 40), dtype=np.uint8)
    for got, window in zip(net.probabilities(windows), windows, strict=True):
        assert got == pytest.approx(plain_probabilities(net, window), abs=1e-5)


def test_training_goes_down_the_gradient():
    rng = np.random.default_rng(5)
    x, y = rng.integers(97, 123, (1, 60), dtype=np.uint8), np.array([1])
    loss = lambda net: -math.log(plain_probabilities(net, x[0])[1])
    for name in ("embed", "kernel", "bias", "out", "out_bias"):
        net = language_id.ByteNet.fresh(["a", "b"], 6)
        before = {k: getattr(net, k).copy() for k in ("embed", "kernel", "bias", "out", "out_bias")}
        trained = language_id.ByteNet(net.labels, *(v.copy() for v in before.values()))
        trained.train(x, y, epochs=1, batch=1, rate=1e-3)
        step = getattr(trained, name) - before[name]  # Adam's first step is rate * sign(gradient)
        moved = np.argwhere(np.abs(step) > 5e-4)
        assert len(moved)
        for at in map(tuple, moved[:: max(1, len(moved) // 6)]):
            sides = []
            for d in (0.01, -0.01):
                value = before[name].copy()
                value[at] += d
                sides.append(loss(language_id.ByteNet(net.labels, *(value if k == name else before[k] for k in before))))
            slope = (sides[0] - sides[1]) / 0.02
            assert abs(slope) < 1e-4 or np.sign(slope) == -np.sign(step[at])


def test_windows_count_by_their_bytes():
    net = language_id.ByteNet.fresh(["a", "b"], 9)
    text = "abcdefg " * 100  # a whole window and a part of one
    raw = text.encode()
    parts = [raw[i : i + language_id.WINDOW] for i in range(0, len(raw), language_id.WINDOW)]
    total = np.zeros(2)
    for part in parts:
        total += len(part) * np.array(plain_probabilities(net, part.ljust(language_id.WINDOW, b"\0")))
    got = language_id.predict(net, [text]).iloc[0]
    assert got.score == pytest.approx(total.max() / total.sum(), abs=1e-4) and got.lang_pred == net.labels[int(total.argmax())]


def test_labels_beyond_the_bound_are_left_out(spark):
    df = spark.createDataFrame([(i, f"word number {i} in some text", f"l{i % 3}" if i < 90 else f"dirty{i}") for i in range(200)], "doc_id long, text string, lang string")
    assert language_id.fit(df, languages=3).labels == ["l0", "l1", "l2"]


def test_quality_edges(spark, docs, empty):
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    assert quality.fit(empty, labels.limit(0)) is None and quality.fit_evidence([("x", 1)]) is None
    out = quality.score_quality(docs, quality.fit(docs, labels), F.col("source"), F.col("lang"), keep_columns=["doc_id"])
    assert out.count() == docs.count() and out.where("__q.score is null").isEmpty()
    assert quality.score_quality(empty, None, F.col("source"), F.col("lang"), keep_columns=["doc_id"]).count() == 0
