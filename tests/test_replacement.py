"""Documents that come again: what goes, what is embedded, what is said of them; snapshots and batches that fail."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import embed
from quillspark.operators.collection import Collections, CollectionSchema, merge_rows
from quillspark.operators.embed import PROVIDERS, EmbedConfig
from quillspark.plans.engine import Engine, EngineConfig
from quillspark.sources.readers import Readers

SECTIONS = [f"{i}. SECTION NUMBER {'ABCDEFGH'[i]}\n" + f"Text of part {i}, which is long enough to be a chunk of its own. " * 3 for i in range(1, 7)]


def counting(path):
    """A provider that writes down the texts that it is asked for."""

    def embed_(texts, dim):
        with open(path, "a") as f:
            f.writelines(t.replace("\n", " ") + "\n" for t in texts)
        return [[float(len(t) % 7 + 1)] + [1.0] * (dim - 1) for t in texts]

    return embed_


def asked(path):
    found = path.read_text().splitlines() if path.exists() else []
    path.write_text("")
    return found


@pytest.fixture
def engine(spark, tmp_path):
    PROVIDERS.register("counting", embed.with_retry(counting(str(tmp_path / "asked")), delay=0.0))
    yield Engine(spark, EngineConfig(str(tmp_path / "store"), EmbedConfig("counting", dim=4)))
    PROVIDERS.known.pop("counting")


def chunks_of(engine, name="c"):
    return sorted(r.text for r in engine.collections.read(name).select("text").collect())


def test_a_shorter_file_leaves_nothing_old(engine, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("\n".join(SECTIONS))
    (folder / "b.txt").write_text("\n".join(SECTIONS[:3]))
    assert engine.process(str(folder), "c").first().status == "success"
    before, first = chunks_of(engine), asked(tmp_path / "asked")
    assert len(before) == len(first) == 9
    # One section of a goes and one changes; b is as it was.
    changed = [SECTIONS[0], SECTIONS[1].replace("long enough", "quite long enough"), *SECTIONS[2:5]]
    (folder / "a.txt").write_text("\n".join(changed))
    assert engine.process(str(folder), "c").first().successful == 8
    after, again = chunks_of(engine), asked(tmp_path / "asked")
    assert len(after) == 8 and not any("part 6" in t for t in after) and sum("quite" in t for t in after) == 1
    assert len(again) == 1 and "quite" in again[0]  # the provider saw the new text alone
    (folder / "a.txt").write_text(" ")
    engine.process(str(folder), "c")
    assert len(chunks_of(engine)) == 3 and not asked(tmp_path / "asked")
    state = {r.doc_id[-5:]: r for r in engine.document_status().collect()}
    assert (state["a.txt"].status, state["a.txt"].stage) == ("failed", "chunking") and (state["b.txt"].status, state["b.txt"].n_chunks) == ("success", 3)


def test_an_upsert_that_fails_is_told(engine, spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(SECTIONS[0])

    def broken(*args, **more):
        raise OSError("disk full")

    monkeypatch.setattr(Collections, "_write", broken)
    with pytest.raises(OSError, match="disk full"):
        engine.process(str(tmp_path / "in"), "c")
    (r,) = engine.document_status().collect()
    assert (r.status, r.stage, r.progress, r.message) == ("failed", "indexing", 80, "OSError: disk full")
    assert not list((tmp_path / "store" / "_tables" / "staged").glob("*"))  # what was staged is gone


def test_vectors_that_fail_are_told(spark, tmp_path):
    def half(texts, dim):
        if any("part 2" in t for t in texts):
            raise ValueError("not this one")
        return [[1.0] * dim for _ in texts]

    PROVIDERS.register("half", embed.with_retry(half, retries=0))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(SECTIONS[:3]))
    (tmp_path / "in" / "b.txt").write_text(SECTIONS[1])
    engine = Engine(spark, EngineConfig(str(tmp_path / "store"), EmbedConfig("half", dim=4)))
    r = engine.process(str(tmp_path / "in"), "c").first()
    PROVIDERS.known.pop("half")
    assert (r.status, r.successful, r.failed) == ("partial", 2, 2) and r.summary.startswith("partial: 2 of 4 indexed, 2 failed") and r.success_rate == 0.5 and r.docs_per_second > 0
    state = {r.doc_id[-5:]: r for r in engine.document_status().collect()}
    assert (state["a.txt"].status, state["a.txt"].message) == ("partial", "2 of 3 chunks indexed")
    assert (state["b.txt"].status, state["b.txt"].stage) == ("failed", "embedding")


def test_files_are_parsed_once(spark, tmp_path):
    count, readers = tmp_path / "parsed", Readers()

    @readers.register("pdf")
    def paid(content):
        with open(count, "a") as f:
            f.write("x")
        return [(content.decode() + " page text that goes on for a while.", "ocr", 90.0)], {}

    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.pdf").write_text(f"file {i}")
    engine = Engine(spark, EngineConfig(str(tmp_path / "store")), readers=readers)
    assert engine.process(str(tmp_path / "in"), "c").first().successful == 3
    assert count.read_text() == "xxx"


def rows_of(spark, pairs):
    return spark.createDataFrame([(d, f"{d}-{i}", text, [1.0, 2.0]) for d, i, text in pairs], "document string, chunk_id string, content string, embedding array<double>")


def test_snapshots(spark, tmp_path):
    store = Collections(spark, str(tmp_path))
    store.create(CollectionSchema("c", 2, buckets=8))
    docs = lambda *ids: spark.createDataFrame([(i,) for i in ids], "document string")
    store.index("c", rows_of(spark, [(f"d{i}", j, "old") for i in range(10) for j in range(3)]), ["chunk_id"], replaces=docs(*[f"d{i}" for i in range(10)]))
    reader = store.read("c")
    store.index("c", rows_of(spark, [("d1", 0, "new")]), ["chunk_id"], replaces=docs("d1", "d2"))
    assert reader.count() == 30  # who reads goes on with what there was
    now = {(r.document, r.text) for r in store.read("c").collect()}
    assert ("d1", "new") in now and ("d1", "old") not in now and "d2" not in {d for d, _ in now} and store.read("c").count() == 25
    assert store.snapshots("c") == [1, 2] and store.read("c", snapshot=1).count() == 30
    seen = store.snapshots("c")[-1]
    store._publish("c", seen, store._folders("c"))
    with pytest.raises(RuntimeError, match="another writer"):
        store._publish("c", seen, {})
    assert 1 <= store.vacuum("c") <= 2 and store.snapshots("c") == [3] and store.read("c").count() == 25 and store.vacuum("c") == 0
    part = store.read("c", docs("d5"))
    assert 0 < len(part.inputFiles()) < len(store.read("c").inputFiles()) and part.where("document = 'd5'").count() == 3


def test_merge_of_replaced(spark):
    old = spark.createDataFrame([("a", "x", 1), ("b", "x", 1), ("c", "y", 1), ("d", None, 1), ("e", "z", 1)], "id string, document string, v int")
    new = spark.createDataFrame([("b", "x", 2), ("f", "x", 2)], "id string, document string, v int")
    gone = spark.createDataFrame([("x",), ("z",), ("x",), ("never",)], "document string")
    assert sorted(tuple(r) for r in merge_rows(old, new, replaced=gone).select("id", "v").collect()) == [("b", 2), ("c", 1), ("d", 1), ("f", 2)]


def test_failing_batches_are_halved():
    calls = []

    def model(texts, dim):
        calls.append(len(texts))
        if "bad" in texts:
            raise ValueError("bad text")
        return [[1.0] * dim for _ in texts]

    texts = [f"t{i}" for i in range(1000)]
    texts[637] = "bad"
    found = embed.embed_each(model, texts, 2, retries=1, delay=0.0)
    assert [i for i, v in enumerate(found) if v is None] == [637] and len(calls) <= 2 + 2 * 10
    calls.clear()
    assert embed.embed_each(model, ["bad", "a", "bad"], 2, 0, 0.0) == [None, [1.0, 1.0], None]
    assert embed.embed_each(model, [], 2, 0, 0.0) == []
    down = iter([True, True, False])

    def flaky(texts, dim):
        if next(down):
            raise ConnectionError("down")
        return [[0.0]] * len(texts)

    assert embed.embed_each(flaky, ["a", "b"], 1, 2, 0.0) == [[0.0], [0.0]]  # the batch came through whole
    assert embed.embed_each(lambda t, d: [[1.0]], ["a", "b"], 1, 0, 0.0) == [[1.0], [1.0]]  # too few vectors are an error


def test_places_by_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), F.lit("x").alias("t")).repartition(7)
    got = embed.numbered(df, ["v"], "at")
    assert all(r.at == r.v for r in got.collect()) and got.count() == 1000
    assert "SinglePartition" not in df._jdf.queryExecution().toString()
    assert embed.numbered(df.limit(0), ["v"], "at").count() == 0


def test_prefixes_follow_the_model():
    assert (embed.for_model("intfloat/E5-large").query_prefix, embed.for_model("x/e5-base", dim=8).passage_prefix) == ("query: ", "passage: ")
    assert embed.for_model("BAAI/bge-m3").query_prefix.startswith("Represent") and embed.for_model("md5") == EmbedConfig()
