"""Scoring stored rows with a model in the workers: batches of like lengths, failures kept apart within a budget, restarts.

A hook is made of two functions, load() -> model, once in each worker, and model(batch) -> one number a row, where a batch
is a list of token arrays. Rows come back with their idx, which alone restores their order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Model = Callable[[list[np.ndarray]], np.ndarray]

_SCORED = "idx long, shard int, loss double, status string, error string"
_models: dict[str, Model] = {}


def _opened(name: str, load: Callable[[], Model]) -> Model:
    """The model of that name: a worker that runs several tasks loads it once."""
    if name not in _models:
        _models.clear()
        _models[name] = load()
    return _models[name]


def score_batches(rows: DataFrame, name: str, load: Callable[[], Model], batch: int = 64, budget: int | None = None) -> DataFrame:
    """idx, shard, loss, status, error of rows (idx, shard, tokens).

    A shard's rows meet in one task, by length, so a batch has rows of about one length. A batch that fails leaves its rows
    with status `failed` and its error; once more than `budget` batches of a shard have failed, the rest of the shard is
    `stopped` unscored; without a budget the error ends the job. Others are `done`. A row of null tokens is one of none.
    """
    dealt = rows.select(F.col("idx").cast("long").alias("idx"), F.col("shard").cast("int").alias("shard"), F.col("tokens").cast("array<int>").alias("tokens"))
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", F.size("tokens"), "idx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _opened(name, load)
        failures: dict[int | None, int] = {}
        for part in batches:
            shards = part.column(1).to_pylist()
            at = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(part.column(2)), 0).to_numpy())]).astype(np.int64)
            values = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            loss, status, errors = np.full(len(shards), np.nan), ["done"] * len(shards), [None] * len(shards)
            a = 0
            while a < len(shards):
                b, shard = a + 1, shards[a]
                while b < len(shards) and b - a < batch and shards[b] == shard:
                    b += 1
                if budget is not None and failures.get(shard, 0) > budget:
                    status[a:b] = ["stopped"] * (b - a)
                else:
                    try:
                        loss[a:b] = model([values[at[i] : at[i + 1]] for i in range(a, b)])
                    except Exception as e:
                        if budget is None:
                            raise
                        failures[shard] = failures.get(shard, 0) + 1
                        status[a:b], errors[a:b] = ["failed"] * (b - a), [f"{type(e).__name__}: {e}"] * (b - a)
                a = b
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(loss, mask=np.isnan(loss)), pa.array(status), pa.array(errors, pa.string())], ["idx", "shard", "loss", "status", "error"])

    return dealt.mapInArrow(run, _SCORED)


def _runs(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the runs that ended."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p.getPath(), "_SUCCESS")
    return sorted(int(p.getPath().getName()[4:]) for p in system.listStatus(folder) if p.getPath().getName().startswith("run=") and system.exists(at(p)))


def score_rest(rows: DataFrame, path: str, name: str, load: Callable[[], Model], batch: int = 64, budget: int = 10) -> DataFrame:
    """Score the rows that have no score in the table at path yet and add them to it as a run of their own, failures
    among them. Returns status and n of this run. Rows that failed or were stopped come again in the next run, done ones
    never do, so each is done once; a run that was cut off has no _SUCCESS and is not read."""
    spark = rows.sparkSession
    runs = _runs(spark, path)
    todo = rows.join(done(spark, path).select("idx"), "idx", "left_anti") if runs else rows
    target = f"{path}/run={(runs or [0])[-1] + 1}"
    score_batches(todo, name, load, batch, budget).write.mode("overwrite").parquet(target)
    return spark.read.schema(_SCORED).parquet(target).groupBy("status").agg(F.count("*").alias("n"))


def _of(spark: SparkSession, path: str, *status: str) -> DataFrame:
    runs = _runs(spark, path)
    if not runs:
        return spark.createDataFrame([], f"{_SCORED}, run int")
    parts = [spark.read.schema(_SCORED).parquet(f"{path}/run={r}").withColumn("run", F.lit(r)) for r in runs]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.filter(F.col("status").isin(*status))


def done(spark: SparkSession, path: str) -> DataFrame:
    """idx, shard, loss, run of the rows that have a score."""
    return _of(spark, path, "done").select("idx", "shard", "loss", "run")


def dead_letters(spark: SparkSession, path: str) -> DataFrame:
    """idx, shard, status, error, run of all that has gone wrong, whether or not it was done later."""
    return _of(spark, path, "failed", "stopped").select("idx", "shard", "status", "error", "run")


def learn_counts(rows: DataFrame, path: str) -> None:
    """Write how often each token id is in rows (tokens): as many rows as there are ids."""
    rows.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).coalesce(1).write.parquet(path)


def count_model(path: str) -> Model:
    """Mean negative log-likelihood under written counts: of a row without tokens none (NaN), of a token that was never
    counted infinite. The batch's ids are looked up all at once."""
    import pyarrow.parquet as pq

    system, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    counts = pq.read_table(root, filesystem=system)
    tokens, n = counts.column("token").to_numpy().astype(np.int64), counts.column("n").to_numpy().astype(np.float64)
    order = np.argsort(tokens)
    tokens, cost = tokens[order], np.append(-np.log(n[order] / n.sum()), np.inf)

    def score(batch: list[np.ndarray]) -> np.ndarray:
        size = np.array([len(x) for x in batch])
        flat = np.concatenate(batch) if batch else np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(tokens, flat), max(0, len(tokens) - 1))
        costs = cost[np.where(tokens[at] == flat, at, -1)] if len(tokens) else np.full(len(flat), np.inf)
        sums = np.bincount(np.repeat(np.arange(len(batch)), size), weights=costs, minlength=len(batch))
        return np.divide(sums, size, out=np.full(len(batch), np.nan), where=size > 0)

    return score
