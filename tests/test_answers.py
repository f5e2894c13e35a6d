"""Answers for tables of questions."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import answer, chat
from quillspark.operators.embed import EmbedConfig
from quillspark.plans.engine import Engine, EngineConfig

KIND = "query_id long, text string, n_history int, last_user string, last_assistant string"


@pytest.fixture
def engine(spark, tmp_path):
    engine = Engine(spark, EngineConfig(str(tmp_path / "store"), EmbedConfig(dim=16), threshold=0.0))
    docs = [(f"d{i}", f"Text {i} says when rent is due and when notice is given, at some length.") for i in range(8)]
    engine.index(spark.createDataFrame(docs, "doc_id string, text string"), "c")
    return engine


def test_a_table_is_answered_as_its_questions_are(engine, spark):
    questions = ["When is rent due?", "What about notice?", "Is there anything on noise at night in the house rules?"]
    asked = spark.createDataFrame([(i, q, 0, None, None) for i, q in enumerate(questions)], KIND)
    got = {r.query_id: r for r in engine.answer_many(asked, "c", k=3).collect()}
    for i, q in enumerate(questions):
        one = engine.ask(q, "c", k=3)
        assert (got[i].answer, got[i].citations, got[i].quality, got[i].query_type, got[i].prompt, got[i].contexts_used, got[i].fallback_used) == (one["answer"], one["citations"], one["quality"], one["query_type"], one["prompt"], 3, False)
        assert [c.score for c in got[i].contexts] == sorted((c.score for c in got[i].contexts), reverse=True) and got[i].warning is None


def test_odd_questions(engine, spark):
    rows = [(1, None, 0, None, None), (2, "  ", 2, "a", "b"), (3, "tell me more", 2, "When is rent due?", "On the first."), (3, "tell me more", 2, "When is rent due?", "On the first.")]
    got = engine.answer_many(spark.createDataFrame(rows[:3], KIND), "c").collect()
    by = {r.query_id: r for r in got}
    assert by[1].contexts_used == by[2].contexts_used == 0 and by[1].quality == "none" and by[1].answer == "No passage answers this."
    assert by[3].query_type == "followup" and "On the first." in by[3].prompt and by[3].contexts_used == 5
    assert engine.answer_many(spark.createDataFrame([], KIND), "c").count() == 0
    bare = engine.answer_many(spark.createDataFrame([(1, "When is rent due?")], "query_id long, text string"), "c").first()
    assert bare.query_type == "new"


def test_providers_fail_by_row_and_are_made_once_a_task(engine, spark, tmp_path):
    made = str(tmp_path / "made")

    def factory():
        with open(made, "a") as f:
            f.write("x")

        def one(prompt, passages):
            if "[bad]" in prompt:
                raise TimeoutError("too slow")
            return None if "[none]" in prompt else f"{len(passages)} passages"

        return one

    def broken():
        raise ConnectionError("no key")

    answer.PROVIDERS.register("maker/*", factory)
    answer.PROVIDERS.register("broken", broken)
    asked = spark.createDataFrame([(i, f"question {i} {'[bad]' if i % 10 == 0 else '[none]' if i % 10 == 1 else 'good'}") for i in range(50)], "query_id long, text string")
    got = engine.answer_many(asked.coalesce(1), "c", "Maker/large", k=2).collect()
    tasks = len((tmp_path / "made").read_text())
    assert 1 <= tasks <= 8
    for r in got:
        failed = r.query_id % 10 < 2
        assert r.fallback_used is failed and r.answer == (chat.FALLBACKS[r.quality] if failed else "2 passages")
        assert r.warning == ("TimeoutError: too slow" if r.query_id % 10 == 0 else "no answer" if failed else None)
    all_ = engine.answer_many(asked, "c", "broken").select("fallback_used", "warning").distinct().collect()
    assert [tuple(r) for r in all_] == [(True, "ConnectionError: no key")]
    with pytest.raises(ValueError, match="no provider"):
        engine.answer_many(asked, "c", "unknown")
    for name in ("maker/*", "broken"):
        answer.PROVIDERS.known.pop(name)


def test_conversations_are_read_by_partition(engine, spark):
    first = engine.ask("When is rent due?", "c")["conversation"]
    for _ in range(3):
        engine.ask("What about notice?", "c", first)
    other = engine.ask("And noise?", "c")["conversation"]
    plan = engine.messages(first)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(part" in plan
    before = engine.history(first)
    files = lambda: len(spark.read.parquet(engine._table("conversations")).inputFiles())
    n = files()
    assert n == 5 and engine.compact() >= 1 and files() < n
    assert engine.history(first) == before and len(engine.history(other)) == 2
    assert engine.clear(first) and not engine.history(first) and engine.compact() >= 1
    assert not engine.history(first) and len(engine.history(other)) == 2 and engine.messages().where(F.col("conversation") == first).count() == 0
