"""The whole way: ingest to a collection, and ask it."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators import answer, chat
from quillspark.operators.chunk import ChunkOptions, chunk_batch
from quillspark.operators.chunkset import first_in
from quillspark.operators.collection import Collections
from quillspark.operators.embed import PROVIDERS, EmbedConfig, embed_new, vector_of
from quillspark.operators.search import search, search_texts
from quillspark.sources.readers import Readers, parse_files, plain_text


def _exploded(batch: DataFrame) -> DataFrame:
    """One row a chunk of what ``chunk_batch`` gives."""
    return batch.select("doc_id", "doc_type", F.posexplode("chunks").alias("ordinal", "chunk")).select("doc_id", "doc_type", "ordinal", "chunk.*")


@dataclass(frozen=True)
class EngineConfig:
    root: str
    embed: EmbedConfig = EmbedConfig()
    chunk: ChunkOptions = ChunkOptions()
    max_contexts: int = 5
    threshold: float = chat.THRESHOLD
    score_mode: str = "similarity"
    temperature: float = 0.3

    def problems(self) -> list[str]:
        found = [] if self.root else ["a root folder is needed"]
        found += [] if self.max_contexts > 0 else ["max_contexts must be positive"]
        return found + ([] if 0 <= self.threshold <= 1 else ["threshold must be from 0 to 1"]) + ([] if 0 <= self.temperature <= 2 else ["temperature must be from 0 to 2"])

    @classmethod
    def from_env(cls, env: Mapping[str, str]) -> EngineConfig:
        """From QUILLSPARK_ROOT, _MODEL, _DIM, _MAX_CONTEXTS, _THRESHOLD and _TEMPERATURE; what isn't set has its default."""
        get = lambda name, kind, default: kind(env[f"QUILLSPARK_{name}"]) if env.get(f"QUILLSPARK_{name}") else default
        base = EmbedConfig()
        return cls(get("ROOT", str, ""), EmbedConfig(model=get("MODEL", str, base.model), dim=get("DIM", int, base.dim)), max_contexts=get("MAX_CONTEXTS", int, 5), threshold=get("THRESHOLD", float, chat.THRESHOLD), temperature=get("TEMPERATURE", float, 0.3))


@dataclass
class Engine:
    spark: SparkSession
    config: EngineConfig
    answer: answer.Answerer = answer.extractive
    readers: Readers = field(default_factory=Readers)

    def __post_init__(self):
        if problems := self.config.problems():
            raise ValueError("; ".join(problems))
        self.collections = Collections(self.spark, self.config.root)

    # Documents

    def process(self, path: str, collection: str) -> DataFrame:
        """Reads, chunks, embeds and upserts all files below ``path``; one row of metrics. A document's id is its path, so files of
        one name in different folders are apart. A file that was processed before replaces what the collection has of it. What
        became of each file is in ``document_status``."""
        return self.process_files(self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path), collection)

    def process_files(self, files: DataFrame, collection: str) -> DataFrame:
        """The same for (path, content) rows; ``lambda files: engine.process_files(files, "c")`` takes the batches of a stream.

        Files are parsed and chunked once, into a table that all else reads. Their state is "processing" until they are indexed, and
        follows from what the collection then has of them; if indexing fails as a whole, it is "failed" and the error is raised."""
        ids = files.select(F.col("path").alias("doc_id"))
        self._say(ids.select("doc_id", F.lit("processing").alias("status"), F.lit("extracting").alias("stage"), F.lit(20).alias("progress"), F.lit(0).alias("n_chunks"), F.lit("").alias("message")))
        read = parse_files(files, self.readers).select(F.col("path").alias("doc_id"), plain_text(F.col("pages")).alias("text"), "status", "errors")
        found = F.col("status") == "failed"
        cut = chunk_batch(read, options=self.config.chunk, also=["status", "errors"]).withColumn("chunks", F.when(found, F.slice("chunks", 1, 0)).otherwise(F.col("chunks")))
        with self._staged(cut) as staged:
            good = staged.where(~found)
            try:
                metrics = self._index_chunks(_exploded(good), good.select(F.col("doc_id").alias("document")), collection)
            except Exception as e:
                self._say(self._states(staged, None, f"{type(e).__name__}: {e}"))
                raise
            self._say(self._states(staged, self.collections.read(collection, good.select(F.col("doc_id").alias("document"))).groupBy("document").count()))
        return metrics

    @staticmethod
    def _states(staged: DataFrame, indexed: DataFrame | None, problem: str = "") -> DataFrame:
        """doc_id, status, stage, progress, n_chunks, message of documents that were chunked, by how many of their chunks (document,
        count) the collection has now."""
        n, failed = F.size("chunks"), F.col("status") == "failed"
        known = staged.withColumn("count", F.lit(0)) if indexed is None else staged.join(indexed.withColumnRenamed("document", "doc_id"), "doc_id", "left")
        have, empty = F.coalesce("count", F.lit(0)), n == 0
        stage = F.when(failed, "failed").when(empty, "chunking").when(have == 0, "embedding" if indexed is not None else "indexing").otherwise("completed")
        progress = F.when(failed, 0).when(empty, 40).when(have == 0, 60 if indexed is not None else 80).otherwise(100)
        state = F.when(failed | empty | (have == 0), "failed").when(have < n, "partial").otherwise(F.col("status"))
        some = F.format_string("%d of %d chunks indexed", have, n)
        said = F.when(failed, F.concat_ws("; ", "errors")).when(empty, F.coalesce("error", "warning")).when(F.lit(bool(problem)), F.lit(problem)).otherwise(F.concat_ws("; ", some, "errors"))
        return known.select("doc_id", state.alias("status"), stage.alias("stage"), progress.alias("progress"), n.alias("n_chunks"), said.alias("message"))

    def _say(self, states: DataFrame) -> None:
        states.withColumn("processed_at", F.current_timestamp()).write.mode("append").parquet(self._table("documents"))

    @contextmanager
    def _staged(self, df: DataFrame) -> Iterator[DataFrame]:
        """``df`` as a table below the root, which goes in the end."""
        path = self._table(f"staged/{uuid.uuid4()}")
        df.write.parquet(path)
        try:
            yield self.spark.read.schema(df.schema).parquet(path)
        finally:
            where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def document_status(self) -> DataFrame:
        """doc_id, status, stage, progress, n_chunks, message, processed_at of each file's last processing, failed ones too."""
        kind = "doc_id string, status string, stage string, progress int, n_chunks int, message string, processed_at timestamp"
        return first_in(self._read(kind, "documents"), ["doc_id"], [F.desc("processed_at")])

    def index(self, docs: DataFrame, collection: str) -> DataFrame:
        """Chunks, embeds and upserts (doc_id, text); one row of metrics. Documents that the collection has are replaced: of a changed
        one new chunks alone are embedded, and what it no longer has goes."""
        with self._staged(chunk_batch(docs, options=self.config.chunk)) as staged:
            return self._index_chunks(_exploded(staged), staged.select(F.col("doc_id").cast("string").alias("document")), collection)

    def _index_chunks(self, chunks: DataFrame, documents: DataFrame, collection: str) -> DataFrame:
        self.collections.create_for_model(collection, self.config.embed)
        name, _ = PROVIDERS.resolve(self.config.embed)
        known = self.collections.known_vectors(collection, documents, name) if self.collections.snapshots(collection) else None
        chunks = chunks.withColumn("document", F.col("doc_id").cast("string"))
        embedded = embed_new(chunks, known, self.config.embed, source_file=F.regexp_extract("document", r"([^/]+)$", 1))
        embedded = embedded.withColumn("chunk_id", F.concat_ws("#", "document", "chunk_id"))
        return self.collections.index(collection, embedded, ["document", "ordinal"], replaces=documents)

    def _table(self, name: str) -> str:
        return f"{self.config.root}/_tables/{name}"

    def _read(self, schema: str, name: str) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._table(name))
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(self._table(name)) if there else self.spark.createDataFrame([], schema)

    # Questions

    def _embed(self, text):
        return vector_of(text, self.config.embed, self.config.embed.query_prefix, PROVIDERS)

    def retrieve(self, question: str, collection: str, k: int | None = None, filter_by: str | None = None) -> DataFrame:
        """Nearest contexts first; the threshold comes after the k."""
        row = self.spark.range(1).select(self._embed(F.lit(question)).alias("v")).first()
        found = search(self.collections.read(collection), row["v"], k or self.config.max_contexts, filter_by, score_mode=self.config.score_mode)
        return found.where(F.col("score") >= self.config.threshold).withColumn("quality", chat.quality(F.col("score")))

    def retrieve_many(self, questions: DataFrame, collection: str, k: int | None = None) -> DataFrame:
        """query_id, rank, id, score, quality for a table of questions (query_id, text)."""
        found = search_texts(self.collections.read(collection), questions, self._embed, k or self.config.max_contexts)
        return found.where(F.col("score") >= self.config.threshold).withColumn("quality", chat.quality(F.col("score")))

    def answer_many(self, questions: DataFrame, collection: str, provider: str = "extractive", k: int | None = None, concise: bool = False) -> DataFrame:
        """Answers for a table of questions (query_id, text and, if there, n_history, last_user, last_assistant): its columns with
        contexts, contexts_used, quality, query_type, citations, prompt_kind, prompt, answer, fallback_used and warning. The provider
        is one of ``answer.PROVIDERS``. Nothing of the questions or answers comes to the driver."""
        contexts = answer.gather(self.retrieve_many(questions, collection, k), self.collections.read(collection))
        return answer.answered(answer.prompted(questions, contexts), answer.PROVIDERS.get(provider), concise)

    def ask(self, question: str, collection: str, conversation: str | None = None, k: int | None = None, concise: bool = False) -> dict:
        """Answer, citations, quality, kind of question, prompt and system prompt. Where the answer's provider fails, a fixed answer by
        quality stands in, and ``fallback_used`` says so. Both messages are kept in the table of conversations."""
        conversation = conversation or str(uuid.uuid4())
        past = self.history(conversation)
        last = lambda role: next((m["text"] for m in reversed(past) if m["role"] == role), None)
        contexts = self.retrieve(question, collection, k).orderBy(F.desc("score"), "id").collect() if self.collections.exists(collection) else []
        kind = "array<struct<text:string,score:double,source_file:string,hierarchy:array<string>,page_numbers:array<int>>>"
        row = self.spark.createDataFrame([(question, len(past), last("user"), last("assistant"), [(c["text"], c["score"], c["source_file"], c["hierarchy"], c["page_numbers"]) for c in contexts])], f"q string, n int, u string, a string, contexts {kind}")
        row = row.withColumns({"type": chat.classify(F.col("q"), F.col("n"), F.col("u")), "score": F.coalesce(F.array_max(F.transform("contexts", lambda c: c["score"])), F.lit(0.0)), "citations": chat.citations(F.col("contexts"))})
        row = row.withColumn("quality", chat.quality(F.col("score"))).withColumn("prompt_kind", chat.prompt_kind(F.col("type"), F.col("quality")))
        got = row.withColumn("prompt", chat.prompt(F.col("prompt_kind"), F.col("q"), chat.context_text(F.col("contexts")), F.col("citations"), F.col("u"), F.col("a"))).first()
        system, failed = chat.SYSTEM_CONCISE if concise else chat.SYSTEM, ""
        try:
            text = self.answer(f"{system}\n\n{got['prompt']}", [c["text"] for c in contexts])
        except Exception as e:  # whatever a model raises
            text, failed = chat.FALLBACKS[got["quality"]], f"{type(e).__name__}: {e}"
        self._keep(conversation, len(past), [("user", question), ("assistant", text)])
        return {"conversation": conversation, "answer": text, "citations": got["citations"], "quality": got["quality"], "query_type": got["type"], "prompt": got["prompt"], "system": system, "contexts_used": len(contexts), "fallback_used": bool(failed), "warnings": [failed] if failed else []}

    def ask_with_citations(self, question: str, collection: str, conversation: str | None = None) -> str:
        """The answer with its sources below it."""
        got = self.ask(question, collection, conversation)
        return got["answer"] + ("\n\nSources:\n" + "\n".join(f"- {c}" for c in got["citations"]) if got["citations"] else "")

    # Conversations: a table of messages, to which clearing appends a mark that hides what came before.

    _MESSAGES = "conversation string, at timestamp, n int, role string, text string, part int"
    #: Partitions of the table of conversations, by a hash of the conversation, of which a look-up reads one.
    _PARTS = 64

    @classmethod
    def _part(cls, conversation: Column) -> Column:
        return F.pmod(F.crc32(conversation.cast("binary")), F.lit(cls._PARTS)).cast("int")

    def _keep(self, conversation: str, n: int, messages: list[tuple[str, str]]) -> None:
        rows = self.spark.createDataFrame([(conversation, n + i, role, text) for i, (role, text) in enumerate(messages)], "conversation string, n int, role string, text string")
        rows.select("conversation", F.current_timestamp().alias("at"), "n", "role", "text", self._part(F.col("conversation")).alias("part")).coalesce(1).write.mode("append").partitionBy("part").parquet(self._table("conversations"))

    def messages(self, conversation: str | None = None) -> DataFrame:
        """All messages of all conversations, or of one, that weren't cleared after them."""
        said = self._read(self._MESSAGES, "conversations")
        if conversation is not None:
            part = zlib.crc32(conversation.encode()) % self._PARTS
            said = said.where((F.col("part") == part) & (F.col("conversation") == conversation))
        said = said.drop("part")
        cleared = F.max(F.when(F.col("role") == "clear", F.col("at"))).over(Window.partitionBy("conversation"))
        return said.withColumn("__cleared", cleared).where((F.col("role") != "clear") & (F.col("__cleared").isNull() | (F.col("at") > F.col("__cleared")))).drop("__cleared")

    def history(self, conversation: str) -> list[dict]:
        """The last messages that are kept, oldest first."""
        kept = self.messages(conversation).orderBy(F.desc("at"), F.desc("n")).limit(chat.KEPT_MESSAGES).collect()
        return [{"role": r["role"], "text": r["text"]} for r in reversed(kept)]

    def compact(self) -> int:
        """Rewrites partitions of the table of conversations that have more than one file as one file each, without messages that were
        cleared; how many. Not while messages are being kept."""
        said, left = self._read(self._MESSAGES, "conversations"), self.messages()
        many = said.select("part", F.input_file_name().alias("file")).distinct().groupBy("part").count().where("count > 1").select("part")
        parts = [r["part"] for r in many.collect()]
        if parts:
            kept = left.withColumn("part", self._part(F.col("conversation"))).where(F.col("part").isin(parts))
            with self._staged(kept) as rows:
                everything = said.select("part").distinct().where(F.col("part").isin(parts))
                gone = [r["part"] for r in everything.join(rows.select("part").distinct(), "part", "left_anti").collect()]
                rows.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self._table("conversations"))
            for part in gone:  # all of it was cleared
                where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self._table('conversations')}/part={part}")
                where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        return len(parts)

    def clear(self, conversation: str) -> bool:
        known = bool(self.history(conversation))
        if known:
            self._keep(conversation, 0, [("clear", "")])
        return known

    def status(self) -> dict:
        stats = self.collections.stats().agg(F.count("*").alias("n"), F.coalesce(F.sum("num_documents"), F.lit(0)).alias("docs")).first()
        return {"status": "ok", "collections": stats["n"], "documents": stats["docs"], "conversations": self.messages().select("conversation").distinct().count()}
