"""The sink of files, classified streams, and filters into variants."""

import time

import pytest
from pyspark.sql import functions as F

from quillspark.operators import chat, chunkset
from quillspark.operators.chunk import chunk_documents
from quillspark.operators.collection import Collections, CollectionSchema
from quillspark.operators.search import parse_filter
from quillspark.sources import files
from quillspark.streaming import ingest


def bytes_below(path):
    return {p.name: p.read_bytes() for p in path.rglob("*") if p.is_file()}


def test_one_file_a_document(spark, tmp_path):
    docs = spark.createDataFrame([(f"d/{i}", f"Text {i} é.\n\n" * (i + 1)) for i in range(20)], "doc_id string, text string")
    for kind, extension in (("markdown", "md"), ("csv", "csv"), ("json", "json")):
        bodies = chunkset.export_documents(chunk_documents(docs), kind)
        files.write_documents(bodies.repartition(3), str(tmp_path / kind), extension)
        want = {f"{r.doc_id.replace('/', '_')}.{extension}": r.body.encode() for r in bodies.collect()}
        assert bytes_below(tmp_path / kind) == want and len(want) == 20
        assert all(p.name.startswith("part-") for p in (tmp_path / kind).iterdir())  # nothing is pending


def test_modes_and_names(spark, tmp_path):
    one = spark.createDataFrame([("a/../b?.md", "x"), ("..", "y"), (None, None)], "doc_id string, body string")
    files.write_documents(one.coalesce(1), str(tmp_path), "md")
    assert set(bytes_below(tmp_path)) == {"a_.._b_.md.md", "md", "null.md"} or len(bytes_below(tmp_path)) == 3
    files.write_documents(one.limit(1), str(tmp_path), "md")
    assert sum(p.is_file() for p in tmp_path.rglob("*")) == 4
    files.write_documents(one.limit(1), str(tmp_path), "md", overwrite=True)
    assert sum(p.is_file() for p in tmp_path.rglob("*")) == 1
    taken = set()
    assert [files.file_name(n, taken) for n in ("a.md", "a.md", "a.md", "b", "b", "")] == ["a.md", "a-1.md", "a-2.md", "b", "b-1", "_"]
    files.write_documents(one.limit(0), str(tmp_path / "none"), "md")
    assert not bytes_below(tmp_path / "none")


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    @F.udf("string")
    def broken(i):
        if i == 37:
            raise ValueError("no body")
        return "x" * 100

    rows = spark.range(40).select(F.col("id").alias("doc_id"), broken("id").alias("body")).repartition(4)
    with pytest.raises(Exception, match="no body"):
        files.write_documents(rows, str(tmp_path), "txt")
    assert not bytes_below(tmp_path)
    with pytest.raises(Exception, match="name and body"):
        files.register(spark)
        spark.range(3).write.format("quill_files").mode("append").save(str(tmp_path))


KIND = "conv_id long, turn long, role string, text string"


def run(spark, tmp_path, rows, timeout_ms):
    """One batch more of the stream; what has been put out up to now."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ingest.ROCKS)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = ingest.classify_stream(spark.readStream.schema(KIND).parquet(f"{tmp_path}/in"), timeout_ms)
    stream.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).format("parquet").start(f"{tmp_path}/out").awaitTermination(100)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    return spark.read.schema(stream.schema).parquet(f"{tmp_path}/out")


def test_stream_equals_classify_turns(spark, tmp_path):
    says = ["When is rent due?", "What about it?", "Define notice.", "A question on another matter altogether, of some length.", "go on"]
    rows = [(c, t, ("user", "assistant", "system", "user")[(t + c) % 4], says[(t * 3 + c) % 5]) for c in range(6) for t in range(24)]
    for at in range(0, 24, 8):
        out = run(spark, tmp_path, [r for r in rows if at <= r[1] < at + 8], 3_600_000)
    want = chat.classify_turns(spark.createDataFrame(rows, KIND))
    assert sorted(map(repr, out.select(*want.columns).collect())) == sorted(map(repr, want.collect())) and {r.query_type for r in out.collect()} >= {"new", "followup", "clarification"}


def test_conversations_are_forgotten(spark, tmp_path):
    run(spark, tmp_path, [(1, 0, "user", "When is rent due?"), (1, 1, "assistant", "On the first."), (2, 0, "user", "And notice?")], 3_000)
    time.sleep(4)
    run(spark, tmp_path, [(3, 0, "user", "Another one?")], 3_000)  # timers are looked at when there is a batch
    out = {(r.conv_id, r.turn): r for r in run(spark, tmp_path, [(1, 2, "user", "tell me more"), (3, 1, "clear", ""), (3, 2, "user", "go on"), (4, 0, "user", None)], 3_600_000).collect()}
    assert (out[1, 2].n_history, out[1, 2].last_user, out[1, 2].query_type) == (0, None, "new")
    assert (out[3, 2].n_history, out[3, 2].query_type) == (0, "new") and out[4, 0].n_history == 0


JSON = ['{"a": {"b": 5, "t": "Some Text"}, "l": [1, {"x": true}], "big": 9007199254740993}', '{"a": {"b": "5", "t": "other"}, "l": [2], "big": 9007199254740992}', '{"a": {"b": 7.5, "t": 3}, "l": "x"}', "null", '{"a": 1}', '{"a": {"b": 1e400}}', None]


@pytest.mark.parametrize(("expression", "want"), [
    ("m.a.b:>=5", [0, 2]), ("m.a.b:<7.5", [0]), ("m.a.b:=7.5", [2]), ("m.a.b:='5'", [1]), ("m.a.t:text", [0]), ("m.a.t:[other, 'Some Text']", [0, 1]), ("m.l.1.x:=true", [0]), ("m.l.0:!=1", [1]),
    ("m.big:=9007199254740993", [0]), ("m.a.b:[5, 7.5]", [0, 2]), ("m.none:=1", []), ("m.a:=1 && n:>=0", [4]), ("m.a.b:!=5", [2]),
])
def test_filters_into_variants(spark, expression, want):
    rows = spark.createDataFrame([(i, j) for i, j in enumerate(JSON)], "n int, j string").select("n", F.try_parse_json("j").alias("m"))
    got = sorted(r.n for r in rows.where(parse_filter(expression, dict(rows.dtypes))).collect())
    assert [n for n in got if n != 5] == want


def test_variants_in_a_collection(spark, tmp_path):
    store = Collections(spark, str(tmp_path))
    assert store.create(CollectionSchema("c", 2, [{"name": "about", "type": "variant"}]))
    rows = spark.createDataFrame([(str(i), "t", [1.0, float(i)], f'{{"year": {2000 + i}, "tags": {{"kind": "k{i % 2}"}}}}') for i in range(6)], "chunk_id string, content string, embedding array<double>, j string").withColumn("about", F.parse_json("j"))
    assert store.index("c", rows, ["chunk_id"]).first().successful == 6
    df = store.read("c")
    assert dict(df.dtypes)["about"] == "variant"
    assert sorted(r.chunk_id for r in df.where(parse_filter("about.year:>2002 && about.tags.kind:=k1", dict(df.dtypes))).collect()) == ["3", "5"]
