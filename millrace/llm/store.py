"""Cutting lineage with tables in the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a local session (tests) gets a temporary one; a cluster has
    no folder that all its machines see, so there it is an error."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="millrace-"))
    return sc.getCheckpointDir()


@contextmanager
def _shuffles_end_with_their_query(spark: SparkSession) -> Iterator[None]:
    """Within, a query's shuffle files go when it ends; otherwise they stay until the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class Table:
    """A DataFrame written as Parquet in the shared folder: what reads `rows` neither recomputes it nor depends on
    shuffle files of a lost executor. remove() deletes the files, or those of one value of the column that they are laid
    out by, once what was made of them is written too."""

    def __init__(self, df: DataFrame, by: str | None = None):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/millrace-{uuid.uuid4().hex}"
        with _shuffles_end_with_their_query(self.spark):
            (df.write.partitionBy(by) if by else df.write).parquet(self.path)
        self.by = by
        self.rows = self.spark.read.schema(df.schema).parquet(self.path)

    def remove(self, value: int | None = None) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path if value is None else f"{self.path}/{self.by}={value}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """The rows of a Table that stays, as a query's lazy result still reads it."""
    return Table(df).rows


def _free(columns: list[str]) -> str:
    name = "_rest"
    while name in columns:
        name += "_"
    return name


def hold(docs: DataFrame, *needed: str) -> DataFrame:
    """docs as the needed columns and a struct of all others, so that an operator's own columns clash with none."""
    rest = [c for c in docs.columns if c not in needed]
    return docs.select(*needed, *([F.struct(*(F.col(f"`{c}`") for c in rest)).alias(_free(docs.columns))] if rest else []))


def release(held: DataFrame, columns: list[str], *new: str) -> DataFrame:
    """What hold() took, under its names and in their order, then the new columns; a new column replaces one of its name."""
    rest = _free(columns)
    inside = set(held.schema[rest].dataType.names) if rest in held.columns else set()
    kept = [c for c in columns if c not in new]
    return held.select(*(F.col(f"{rest}.`{c}`").alias(c) if c in inside else F.col(f"`{c}`") for c in kept), *new)
