"""The scoring hook: one model a worker, batches of like lengths, budgets, restarts, streams."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import corpus, inference
from millrace.streaming import incremental

ROWS = [(i, i // 40, [i % 7] * (1 + i * 13 % 29)) for i in range(100)] + [(100, 2, []), (101, 2, None)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "idx long, shard int, tokens array<int>").repartition(5)


@pytest.fixture(scope="module")
def counts(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("counts") / "c")
    inference.learn_counts(rows, path)
    return path


def plain():
    n = Counter(t for _, _, tokens in ROWS for t in tokens or [])
    total = sum(n.values())
    return {i: sum(-math.log(n[t] / total) for t in tokens) / len(tokens) if tokens else None for i, _, tokens in ROWS}


def test_losses(rows, counts):
    got = inference.score_batches(rows, counts, lambda: inference.count_model(counts), batch=8).collect()
    want = plain()
    assert len(got) == len(ROWS) and {r.status for r in got} == {"done"}
    assert all(r.loss == (None if want[r.idx] is None else pytest.approx(want[r.idx])) for r in got)


def test_batches_have_like_lengths_and_one_model_a_worker(spark, rows):
    """A hook that returns its batch's size, spread of lengths and the count of loads in the worker."""

    def load():
        import builtins

        builtins.loads = getattr(builtins, "loads", 0) + 1
        return lambda batch: np.full(len(batch), 1000 * builtins.loads + max(map(len, batch)) - min(map(len, batch)))

    got = inference.score_batches(rows, "spread", load, batch=10).collect()
    assert max(r.loss % 1000 for r in got) <= 14 and {r.loss // 1000 for r in got} == {1}
    with pytest.raises(Exception, match="no model"):
        inference.score_batches(rows, "bad", lambda: (_ for _ in ()).throw(OSError("no model"))).collect()
    assert inference.score_batches(rows.limit(0), "spread", load).count() == 0


def failing(most):
    def run(batch):
        if max(map(len, batch)) > most:
            raise RuntimeError(f"longer than {most}")
        return np.zeros(len(batch))

    return lambda: run


def test_a_shard_stops_past_its_budget(rows):
    with pytest.raises(Exception, match="longer than 5"):
        inference.score_batches(rows, "f5", failing(5), batch=1).collect()
    got = inference.score_batches(rows, "f5", failing(5), batch=1, budget=3).collect()
    for shard in range(3):
        mine = sorted((len(ROWS[r.idx][2] or []), r.idx, r.status) for r in got if r.shard == shard)
        short = sum(n <= 5 for n, _, _ in mine)
        assert [s for _, _, s in mine] == ["done"] * short + ["failed"] * 4 + ["stopped"] * (len(mine) - short - 4)
    assert {r.error for r in got} == {None, "RuntimeError: longer than 5"}


def test_failed_rows_come_again_and_are_done_once(spark, rows, tmp_path):
    path = str(tmp_path / "scores")
    assert inference.done(spark, path).count() == 0
    first = {r.status: r.n for r in inference.score_rest(rows, path, "f9", failing(9), batch=2, budget=1).collect()}
    assert set(first) == {"done", "failed", "stopped"} and sum(first.values()) == len(ROWS)
    second = {r.status: r.n for r in inference.score_rest(rows, path, "f20", failing(20), batch=2, budget=1000).collect()}
    assert sum(second.values()) == first["failed"] + first["stopped"] and set(second) == {"done", "failed"}
    (tmp_path / "scores" / "run=3").mkdir()  # a run that was cut off
    (tmp_path / "scores" / "run=3" / "part-0.parquet").write_bytes(b"half")
    third = {r.status: r.n for r in inference.score_rest(rows, path, "f99", failing(99)).collect()}
    assert third == {"done": second["failed"]}
    done = inference.done(spark, path)
    assert done.count() == len(ROWS) == done.select("idx").distinct().count() and done.agg(F.max("run")).first()[0] == 3
    dead = inference.dead_letters(spark, path)
    assert dead.filter("run = 2").count() == second["failed"] and dead.filter("run = 3").count() == 0
    assert inference.score_rest(rows, path, "f99", failing(99)).collect() == []


def test_streamed_rows_are_scored_by_the_hook(spark, rows, counts, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    score = lambda batch: inference.score_batches(batch, counts, lambda: inference.count_model(counts))
    for low, high in ((0, 50), (50, 102)):
        rows.filter((F.col("idx") >= low) & (F.col("idx") < high)).write.mode("append").parquet(source)
        incremental.score_new_files(spark.readStream.schema(rows.schema).parquet(source), score, out, mark).awaitTermination()
    want = plain()
    got = {r.idx: r.loss for r in spark.read.parquet(out).collect()}
    assert got == {i: None if v is None else pytest.approx(v) for i, v in want.items()}


def test_a_silent_domains_tail_is_flushed(spark, tmp_path):
    """Chunks of the stream and the tails that its timers flush are those of the batch fold with flush_tail."""
    rng = np.random.default_rng(0)
    docs = [(i, f"d{i % 3}", [int(x) for x in rng.integers(1, 50, rng.integers(3, 60))]) for i in range(40)]
    frame = spark.createDataFrame([(i, d, t, [x % 2 == 0 for x in t]) for i, d, t in docs], "doc_id long, domain string, tokens array<int>, spaced array<boolean>")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
        packed = incremental.pack_arriving_until_silent(stream, 32, 0, [7, 9], [11], silence_ms=500)
        query = packed.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).trigger(processingTime="200 milliseconds").start()
        want = corpus.pack_sentences(frame, 32, eos=0, ends=[7, 9], newlines=[11], flush_tail=True).select("domain", "tokens", "padding")
        want = sorted(map(str, want.collect()))
        for _ in range(60):
            done = query.awaitTermination(1)
            if done or query.lastProgress and spark.read.schema(packed.schema).parquet(str(tmp_path / "out")).count() >= len(want):
                break
        query.stop()
    finally:
        spark.conf.set(provider, before)
    assert sorted(map(str, spark.read.schema(packed.schema).parquet(str(tmp_path / "out")).collect())) == want
