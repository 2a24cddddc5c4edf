"""Readers and writers of text and JSON files, with the conventions of corpus and prompt data."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import newlines, strip, trailing_number

RAW = T.StructType([T.StructField("text", T.StringType()), T.StructField("meta", T.StructType([T.StructField("pile_set_name", T.StringType())]))])


def corpus(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, block (where the part of the file that a task reads begins), text, domain of JSON lines; a malformed line is an error."""
    return spark.read.schema(RAW).option("mode", "FAILFAST").json(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "text", F.col("meta.pile_set_name").alias("domain"))


def numbered(docs: DataFrame) -> DataFrame:
    """corpus() with a doc_id: lines counted from 0 in order of file, block and line. Lines are numbered within their
    block, which is what one task reads; only the blocks' sizes are summed over the files."""
    blocks = docs.groupBy("file", "block").agg(F.count("*").alias("_n"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.select("file", "block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("file", "block").orderBy("_line")
    lines = docs.withColumn("_line", F.monotonically_increasing_id()).withColumn("_in", F.row_number().over(inside) - 1)
    return lines.join(bases, ["file", "block"]).withColumn("doc_id", F.col("_base") + F.col("_in")).drop("_line", "_in", "_base")


def file_list(spark: SparkSession, path: str, seed: int = 233, saved: str | None = None) -> list[str]:
    """The parts of a corpus, files or folders of files, in a seeded order of their names. saved: where the list is kept, so
    that files that are added later do not change the order of a corpus that has been begun; it is written if it is not there."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    if saved:
        known = hadoop.Path(saved)
        if known.getFileSystem(conf).exists(known):
            return [r.file for r in spark.read.schema("place long, file string").json(saved).orderBy("place").collect()]
    folder = hadoop.Path(path)
    found = [str(s.getPath().toString()) for s in folder.getFileSystem(conf).listStatus(folder)]
    names = {f: f.rstrip("/").rsplit("/", 1)[1] for f in found}
    order = sorted((f for f in found if names[f][0] not in "._"), key=lambda f: (hashlib.md5(f"{seed}:{names[f]}".encode()).hexdigest(), names[f]))
    if saved:
        spark.createDataFrame(list(enumerate(order)), "place long, file string").coalesce(1).write.json(saved)
    return order


def corpus_of(spark: SparkSession, parts: list[str], first: int = 0, last: int | None = None) -> DataFrame:
    """corpus() of the parts from first to last of a list, with their place in it; no other is opened."""
    chosen = list(enumerate(parts))[first:last]
    if not chosen:
        return corpus_schema(spark)
    # a part is a file or a folder of files; its name follows the name of the folder that all parts lie in
    names = [f.rstrip("/").rsplit("/", 1) for _, f in chosen]
    if len({folder for folder, _ in names}) > 1:
        raise ValueError("parts of several folders")
    parent = re.sub("^[a-z0-9]+:/+", "/", names[0][0])
    path = F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B")))
    part = F.regexp_extract(path, re.escape(parent) + "/([^/]+)", 1)
    places = spark.createDataFrame([(i, name) for (i, _), (_, name) in zip(chosen, names, strict=True)], "place int, _part string")
    docs = corpus(spark, [f for _, f in chosen]).withColumn("_part", part)
    return docs.join(places, "_part").select("file", "block", "text", "domain", "place")


def corpus_schema(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "file string, block long, text string, domain string, place int")


def enough_parts(spark: SparkSession, parts: list[str], needed: int, size: Column | None = None) -> tuple[int, list[int]]:
    """How many parts of a list, from its beginning, hold `needed` rows (or as much of the sum of size), and what each of
    them holds; all parts if they hold less. Parts are opened in turns of one, two, four and so on."""
    held: list[int] = []
    step = 1
    while len(held) < len(parts) and sum(held) < needed:
        end = min(len(held) + step, len(parts))
        sums = corpus_of(spark, parts, len(held), end).groupBy("place").agg(F.sum(F.lit(1) if size is None else size).alias("n")).collect()  # one row a part
        by = {r.place: int(r.n or 0) for r in sums}
        held += [by.get(i, 0) for i in range(len(held), end)]
        step *= 2
    total, n = 0, 0
    while n < len(held) and total < needed:
        total += held[n]
        n += 1
    return n, held[:n]


def write_corpus(docs: DataFrame, path: str, per_file: int = 1_000_000) -> None:
    """JSON lines of docs (text, source), so many to a file."""
    docs.select("text", F.struct(F.col("source").alias("pile_set_name")).alias("meta")).write.option("maxRecordsPerFile", per_file).json(path)


def prompts(spark: SparkSession, path: str) -> DataFrame:
    """prompt, output ARRAY<STRING> of JSON lines whose output is a string, a list of strings or missing; <n> is a line
    break in prompts."""
    raw = spark.read.schema("prompt string, output string").json(path)
    return raw.select(newlines(F.col("prompt")).alias("prompt"), as_list(F.col("output")).alias("output"))


def as_list(output: Column) -> Column:
    """A JSON list of strings as an array, any other string as an array of itself."""
    return F.when(output.isNull(), None).when(F.ltrim(output).startswith("["), F.coalesce(F.from_json(output, "array<string>"), F.array(output))).otherwise(F.array(output))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """prompt of each line, stripped, <n> as a line break."""
    return spark.read.text(path).select(newlines(strip(F.col("value"))).alias("prompt"))


def write_scores(scores: DataFrame, path: str) -> None:
    """scores (file_id, pos, ...) in a folder scores_<file_id> each, in order of pos."""
    named = scores.withColumn("file", F.concat(F.lit("scores_"), F.col("file_id").cast("string"))).drop("file_id")
    named.repartition("file").sortWithinPartitions("file", "pos").write.partitionBy("file").parquet(path)


def scores(spark: SparkSession, path: str) -> DataFrame:
    """file_id, pos, score of tables scores_<n>.parquet or in folders scores_<n>, to be ordered by number and place: read the file's number from its
    name, so scores_10 is after scores_9."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    table = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path)
    return table.select("*", trailing_number(F.regexp_extract(F.col("_metadata.file_path"), r"(scores_\d+)", 1)).alias("file_id"), name.alias("file"))


def manifest_of_names(names: DataFrame) -> DataFrame:
    """name, number, place: files in order of their trailing number, names without one as 0; a file list is small."""
    numbered = names.withColumn("number", trailing_number(F.col("name")))
    return numbered.withColumn("place", F.row_number().over(Window.orderBy("number", "name")) - 1)


def write_report(lines: DataFrame, path: str) -> None:
    lines.select("value").write.text(path)


def write_metadata(spark: SparkSession, path: str, **values) -> None:
    """One JSON object."""
    spark.createDataFrame([values]).coalesce(1).write.mode("overwrite").json(path)
