"""Streams: files into a collection, and bounded conversation history as keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quillspark.operators.chat import KEPT_MESSAGES, classify

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _LastMessages(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.messages = handle.getListState("messages", "turn long, role string, text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        new = new[new["role"].isin(["user", "assistant"])].sort_values("turn")
        known = [tuple(m) for m in self.messages.get()] if self.messages.exists() else []
        kept = sorted(known + list(new[["turn", "role", "text"]].itertuples(index=False, name=None)))[-KEPT_MESSAGES:]
        self.messages.put(kept)
        yield pd.DataFrame([(key[0], *m) for m in kept], columns=["conv_id", "turn", "role", "text"])

    def close(self) -> None:
        pass


def conversation_history(messages: DataFrame) -> DataFrame:
    """A stream of conv_id, turn, role, text -> after each batch, the last ten messages of each conversation that it touched.
    State is bounded by count alone; it needs the RocksDB state store."""
    return messages.groupBy("conv_id").transformWithStateInPandas(_LastMessages(), "conv_id long, turn long, role string, text string", "Update", "None")


class _Questions(StatefulProcessor):
    """What came before each question of a conversation. State is its last messages, which a role ``clear`` and a time without any
    take away."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.messages = handle.getListState("messages", "turn long, role string, text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = [tuple(m) for m in self.messages.get()] if self.messages.exists() else []
        out = []
        new = pd.concat(list(rows)).sort_values("turn", kind="stable")
        for turn, role, text in new[["turn", "role", "text"]].itertuples(index=False, name=None):
            if role == "clear":
                known = []
            elif role in ("user", "assistant"):
                if role == "user":
                    last = lambda who: next((t for _, r, t in reversed(known) if r == who and t is not None), None)  # noqa: B023, E731
                    out.append((key[0], turn, text, len(known), last("user"), last("assistant")))
                known = [*known, (turn, role, text)][-KEPT_MESSAGES:]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if known:
            self.messages.put(known)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
        else:
            self.messages.clear()
        yield pd.DataFrame(out, columns=["conv_id", "turn", "text", "n_history", "last_user", "last_assistant"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.messages.clear()
        return iter([])

    def close(self) -> None:
        pass


def classify_stream(messages: DataFrame, timeout_ms: int = 30 * 60 * 1000) -> DataFrame:
    """``chat.classify_turns`` of a stream of conv_id, turn, role, text: each question once, with its kind. A conversation without
    messages for ``timeout_ms`` is forgotten, as is one of which a message has the role ``clear``; both begin anew after that. A
    batch's messages are taken by turn, after those of batches before. It needs the RocksDB state store. Time-outs are looked at in each batch;
    a query that ends when its input is read needs ``spark.sql.streaming.noDataMicroBatches.enabled`` off, or it waits for them."""
    kind = "conv_id long, turn long, text string, n_history long, last_user string, last_assistant string"
    asked = messages.groupBy("conv_id").transformWithStateInPandas(_Questions(timeout_ms), kind, "Append", "ProcessingTime")
    return asked.withColumn("query_type", classify(F.col("text"), F.col("n_history"), F.col("last_user")))


def index_files(spark: SparkSession, path: str, checkpoint: str, handle: Callable[[DataFrame], None]) -> StreamingQuery:
    """New files below ``path``, batch by batch, to ``handle`` (read, chunk, embed, upsert). Upserts make repeats harmless."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: handle(df)).start()
