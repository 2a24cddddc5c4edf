"""Streaming versions of the incremental jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from millrace.operators.corpus import pack_stream
from millrace.sources import binidx


def score_new_files(stream: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Score what arrives and add it to path, one folder a micro-batch; a batch that runs again after a failure replaces
    its own folder, so each row is in the output once."""

    def one(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pack_arriving(stream: DataFrame, length: int, eos: int, ends: list[int], newlines: list[int] = ()) -> DataFrame:
    """domain, tokens, padding: sentence-bounded chunks of each domain's documents (doc_id, domain, tokens, spaced) in
    order of arrival; what does not fill a chunk yet waits in the state, less than `length` tokens a domain. No chunk count per document ends a
    stream here."""
    end_set, newline_set = set(ends), frozenset(newlines)

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get) if state.exists else [[], []]
        docs = [(list(held[0]), list(held[1]))]
        rows = pd.concat(list(frames)).sort_values("doc_id", kind="stable")
        docs += [([int(x) for x in t], [bool(x) for x in s]) for t, s in zip(rows["tokens"], rows["spaced"], strict=True)]
        chunks = list(pack_stream(docs, length, eos, end_set, newline_set, most=1 << 60, keep_singletons=True))
        used = sum(len(c) for c, _ in chunks)
        chunks = [c for c in chunks if len(c[0]) > 1]
        tokens, spaced = [t for d, _ in docs for t in d], [x for _, s in docs for x in s]
        state.update((tokens[used:], spaced[used:]))
        yield pd.DataFrame({"domain": [key[0]] * len(chunks), "tokens": [c for c, _ in chunks], "padding": [p for _, p in chunks]})

    return stream.groupBy("domain").applyInPandasWithState(step, "domain string, tokens array<int>, padding int", "tokens array<int>, spaced array<boolean>", "append", GroupStateTimeout.NoTimeout)


class _Packer(StatefulProcessor):
    """Packs a domain's documents as they come; a timer flushes what is left once the domain has been silent."""

    def __init__(self, length: int, eos: int, ends: set[int], newlines: frozenset[int], silence_ms: int, keep_ms: int):
        self.length, self.eos, self.ends, self.newlines, self.silence_ms, self.keep_ms = length, eos, ends, newlines, silence_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.left = handle.getValueState("left", "tokens array<int>, spaced array<boolean>", self.keep_ms)

    def _out(self, key: tuple, chunks: list[tuple[list[int], int]]) -> pd.DataFrame:
        return pd.DataFrame({"domain": [key[0]] * len(chunks), "tokens": [c for c, _ in chunks], "padding": [p for _, p in chunks]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held = self.left.get() if self.left.exists() else ([], [])
        new = pd.concat(list(rows)).sort_values("doc_id", kind="stable")
        docs = [(list(held[0]), list(held[1]))] + [([int(x) for x in t], [bool(x) for x in s]) for t, s in zip(new["tokens"], new["spaced"], strict=True)]
        chunks = list(pack_stream(docs, self.length, self.eos, self.ends, self.newlines, most=1 << 60, keep_singletons=True))
        used = sum(len(c) for c, _ in chunks)
        self.left.update(([t for d, _ in docs for t in d][used:], [x for _, s in docs for x in s][used:]))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silence_ms)
        yield self._out(key, [c for c in chunks if len(c[0]) > 1])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        tokens = list(self.left.get()[0]) if self.left.exists() else []
        self.left.clear()
        yield self._out(key, [(tokens, self.length - len(tokens))] if tokens else [])

    def close(self) -> None:
        pass


def pack_arriving_until_silent(stream: DataFrame, length: int, eos: int, ends: list[int], newlines: list[int] = (), silence_ms: int = 600_000, keep_ms: int = 7 * 86_400_000) -> DataFrame:
    """pack_arriving(), whose tail does not wait for ever: a domain that has been silent for silence_ms gives up what has
    not filled a chunk, as the batch fold does with flush_tail, and starts anew with its next document. State that is not
    touched for keep_ms goes even if the query was down when its timer was due. The session needs the RocksDB state store."""
    packer = _Packer(length, eos, set(ends), frozenset(newlines), silence_ms, keep_ms)
    return stream.groupBy("domain").transformWithStateInPandas(packer, "domain string, tokens array<int>, padding int", "Append", "processingTime")


def shards_to_table(spark: SparkSession, path: str, out: str, checkpoint: str, name: str = "data", per_batch: int = 1_000_000) -> None:
    """Add the rows of the shards below path that are not in the table out yet, at most per_batch at a time, in some two
    tasks for each core. The table's log and the query's checkpoint see to it that each row is in it once, whenever the job was stopped."""
    spark.dataSource.register(binidx.BinIdx)
    per_task = min(100_000, max(1000, per_batch // (2 * spark.sparkContext.defaultParallelism)))
    rows = spark.readStream.format("binidx").options(path=path, name=name, rowsPerBatch=per_batch, rowsPerTask=per_task, checkpoint=checkpoint).load()
    query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def log_means(stream: DataFrame, every: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """window_start, name, mean, n of a metric stream (ts, name, value), with a watermark."""
    means = stream.withWatermark("ts", late).groupBy(F.window("ts", every), "name").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    return means.select(F.col("window.start").alias("window_start"), "name", "mean", "n")
