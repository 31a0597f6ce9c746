"""Structured Streaming forms of first-wins deduplication and of the append of results (section 2.13)."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from quern.functions import text as t
from quern.operators.corpus import LEAST_WORDS, bare_article, dedup_key, enrich_codes

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _keyed(rows: DataFrame, least_words: int) -> DataFrame:
    """Long enough rows with ``key``; rows without a key are duplicates of nothing: their document id and text stand for it."""
    own = enrich_codes(rows).withColumn("article_id", bare_article(F.col("article_id")))
    keyed = dedup_key(own.filter(F.size(t.words(F.col("text"))) >= least_words))
    return keyed.withColumn("key", F.coalesce("key", F.concat(F.lit("_nokey_"), "doc_id", F.lit("_"), F.md5("text"))))


def dedup_stream(rows: DataFrame, least_words: int = LEAST_WORDS, time_col: str | None = None, watermark: str | None = None, all_keys: bool = False) -> DataFrame:
    """A stream of corpus rows without short ones and without rows of a key seen before: the first arrival wins. Rows
    without a key pass. The state of keys is dropped when they are older than the watermark; ``all_keys`` keeps the state
    of every key for ever, which a stream without an end has to be given room for."""
    if not (time_col and watermark) and not all_keys:
        raise ValueError("a watermark on a time column bounds the state; all_keys says that it may grow with the keys")
    key = _keyed(rows, least_words)
    if time_col and watermark:
        return key.withWatermark(time_col, watermark).dropDuplicatesWithinWatermark(["key"]).drop("key")
    return key.dropDuplicates(["key"]).drop("key")


class FirstOfKey(StatefulProcessor):
    """The first row of a key, by event time; the key is forgotten ``ttl`` milliseconds after that row."""

    def __init__(self, time_col: str, ttl: int):
        self.time_col, self.ttl = time_col, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "until long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        best = None
        for part in rows:
            if len(part):
                one = part.sort_values(self.time_col, kind="stable").iloc[:1]
                best = one if best is None or one[self.time_col].iloc[0] < best[self.time_col].iloc[0] else best
        if best is not None and not self.until.exists():
            until = int(best[self.time_col].iloc[0].timestamp() * 1000) + self.ttl
            self.until.update((until,))
            self.handle.registerTimer(until)
            yield best

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.until.clear()
        return iter([])

    def close(self) -> None:
        pass


def dedup_with_ttl(rows: DataFrame, time_col: str, watermark: str, ttl_seconds: int, least_words: int = LEAST_WORDS) -> DataFrame:
    """ST1. A stream of corpus rows without short ones: of the rows of a key the first by event time, and the first again once
    ``ttl_seconds`` have passed since, by the watermark. A key's state is a number and a timer, so it is bounded by the keys
    of that time. Rows behind the watermark are dropped, and counted by :func:`late_rows`. Of a key that comes very often each
    task sends the first row of a batch only. Start it with :func:`started`."""
    key = _keyed(rows, least_words)

    def thinned(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.sort_values(time_col, kind="stable").drop_duplicates("key")

    first = key.mapInPandas(thinned, key.schema).withWatermark(time_col, watermark)
    out = first.groupBy("key").transformWithStateInPandas(FirstOfKey(time_col, ttl_seconds * 1000), key.schema, "Append", "EventTime")
    return out.drop("key")


def started(stream: DataStreamWriter) -> StreamingQuery:
    """Starts a stream whose state lies in RocksDB, on the executors' disks and in the checkpoint, not in their heaps."""
    spark = SparkSession.getActiveSession()
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return stream.start()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def late_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark and were dropped."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in json.loads(p.json)["stateOperators"])


def upsert_results(stream: DataFrame, path: str, checkpoint: str):
    """Appends results by batch; a batch that is run again replaces its own part, so each result counts once. Read back
    with :func:`quern.sources.readers.last_results` on ``batch``."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("seen", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
