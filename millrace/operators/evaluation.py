"""Evaluation aggregates and metric logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def task_accuracy(results: DataFrame) -> DataFrame:
    """task, accuracy: acc_norm where there is one, else acc; a task with neither is an error."""
    chosen = F.coalesce("acc_norm", "acc")
    return results.select("task", F.when(chosen.isNull(), F.raise_error(F.concat(F.lit("no accuracy for "), "task")).cast("double")).otherwise(chosen).alias("accuracy"))


def macro_average(results: DataFrame) -> DataFrame:
    """task, accuracy, and one row `avg` with the plain mean over tasks."""
    each = task_accuracy(results)
    return each.union(each.agg(F.lit("avg"), F.avg("accuracy")))


def log_windows(log: DataFrame, every: int) -> DataFrame:
    """window, name, mean, n of a log (step, name, value): means over `every` steps."""
    return log.groupBy(F.floor(F.col("step") / every).alias("window"), "name").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


def ordered_mean(value: str, order: str) -> Column:
    """An aggregate: the mean of value, added up in the order of a column and not as tasks happen to meet, so that it is the
    same to the last bit on every run. A group's values are in one row: for groups that a window bounds."""
    rows = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v")))))
    return F.aggregate(rows, F.lit(0.0), lambda s, x: s + x["v"], lambda s: F.try_divide(s, F.size(rows)))


def fixed(value: Column, digits: int) -> Column:
    """A number with so many decimals, its exact binary value rounded half to even as C's printf does; format_string rounds
    the shortest decimal that stands for it half up."""
    size = F.when(F.isnan(value), "nan").when(value == float("inf"), "inf").when(value == -float("inf"), "-inf")
    return F.when(value.isNotNull(), F.coalesce(size, F.call_function("format_number", value, F.lit("0." + "0" * digits))))


def log_lines(log: DataFrame) -> DataFrame:
    """step, line: the metrics of a step, names in order, four decimals, joined by bars. A metric without a name or a value
    has no place in the line; a step with none has no line."""
    item = F.concat("name", F.lit(": "), fixed(F.col("value"), 4))
    items = F.array_sort(F.collect_list(F.when(item.isNotNull(), F.struct("name", item.alias("item")))))
    return log.groupBy("step").agg(F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda x: x["item"]), " | ")).alias("line"))


def at_checkpoints(log: DataFrame, interval: int) -> DataFrame:
    """step, name, mean, n: for each checkpoint that a log (step, name, value) reaches, every `interval` steps, what was
    logged since the one before it, that step included."""
    reached = log.agg(F.max("step")).first()[0]
    steps = checkpoints(log.sparkSession, interval, reached if reached is not None else 0, interval)
    since = log.withColumn("_c", (F.ceil(F.col("step") / interval) * interval).cast("long")).withColumn("_c", F.greatest("_c", F.lit(interval).cast("long")))
    means = since.groupBy("_c", "name").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    return means.join(steps, F.col("_c") == F.col("step")).select("step", "name", "mean", "n")


def write_evals(preds: DataFrame, results: DataFrame, path: str) -> None:
    """Predictions and results (step, ...) of evaluations below path, a folder for each step; steps that are there already
    are replaced, others stay."""
    # a stated number: else few bytes, which may be many folders, are put together in few tasks
    n = int(preds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for name, table in (("preds", preds), ("results", results)):
        table.repartition(n, "step").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("step").parquet(f"{path}/eval/{name}")


def read_evals(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The predictions and results of all steps."""
    return spark.read.parquet(f"{path}/eval/preds"), spark.read.parquet(f"{path}/eval/results")


def checkpoints(spark, first: int, last: int, interval: int, inclusive: bool = True) -> DataFrame:
    """step: the checkpoints that an evaluation visits."""
    return spark.range(first, last + (1 if inclusive else 0), interval).withColumnRenamed("id", "step")


def dataset_mean(losses: DataFrame) -> DataFrame:
    """One row: the mean loss over distinct rows (idx, loss); a row that padding repeats counts once."""
    return losses.dropDuplicates(["idx"]).agg(F.avg("loss").alias("mean"), F.count("*").alias("n"))


def answers(rows: DataFrame, sidecar: DataFrame | None = None) -> DataFrame:
    """rows (idx, output ARRAY<STRING>) with the sidecar's output where it has one."""
    if sidecar is None:
        return rows
    other = sidecar.select("idx", F.col("output").alias("_o"))
    return rows.join(other, "idx", "left").withColumn("output", F.coalesce("_o", "output")).drop("_o")


def label_map(rows: DataFrame, first: Column) -> DataFrame:
    """token, answer: which answer begins with a token, by the first answers of rows (idx, output ARRAY<STRING>); first is
    an expression over `answer`. Of several answers with one first token the last row's counts; rows without an answer, or
    whose answer has no token, have none."""
    each = rows.select("idx", F.get("output", F.lit(0)).alias("answer")).withColumn("token", first)
    return each.filter("token is not null").groupBy("token").agg(F.max_by("answer", "idx").alias("answer"))


def capped(rows: DataFrame, most: int | None) -> DataFrame:
    """The first rows (idx from 0), at most so many; none at all is an error."""
    out = rows if most is None else rows.filter(F.col("idx") < most)
    if not out.head(1):
        raise ValueError("no rows")
    return out
