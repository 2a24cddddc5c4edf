"""Text, JSON and score files, and streams over them."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import selection
from millrace.sources import files
from millrace.streaming import incremental


def test_corpus(spark, tmp_path):
    rows = [(f"text {i}\nline", f"d{i % 3}") for i in range(25)] + [("", "d0")]
    files.write_corpus(spark.createDataFrame(rows, "text string, source string").coalesce(1), str(tmp_path / "c"), per_file=10)
    docs = files.numbered(files.corpus(spark, str(tmp_path / "c"))).orderBy("doc_id").collect()
    assert [(r.text, r.domain) for r in docs] == rows and [r.doc_id for r in docs] == list(range(26))
    assert len({r.file for r in docs}) == 3
    (tmp_path / "bad.json").write_text('{"text": "a"}\n{"text": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.corpus(spark, str(tmp_path / "bad.json")).collect()


def test_prompts(spark, tmp_path):
    lines = [{"prompt": "a<n>b", "output": ["x", "y"]}, {"prompt": "c", "output": "z"}, {"prompt": "d"}, {"prompt": "e", "output": "[not a list"}]
    (tmp_path / "p.json").write_text("".join(json.dumps(x) + "\n" for x in lines))
    got = {r.prompt: r.output for r in files.prompts(spark, str(tmp_path / "p.json")).collect()}
    assert got == {"a\nb": ["x", "y"], "c": ["z"], "d": None, "e": ["[not a list"]}
    (tmp_path / "t.txt").write_text("  one<n>two \n\nthree\n")
    assert [r.prompt for r in files.lines(spark, str(tmp_path / "t.txt")).collect()] == ["one\ntwo", "", "three"]


def test_score_files(spark, tmp_path):
    rows = [(f, i, f + i / 10) for f in (2, 10, 9) for i in range(3)]
    files.write_scores(spark.createDataFrame(rows, "file_id int, pos int, score double"), str(tmp_path / "s"))
    back = files.scores(spark, str(tmp_path / "s")).orderBy("file_id", "pos").collect()
    assert [(r.file_id, r.pos, r.score) for r in back] == sorted(rows)
    names = spark.createDataFrame([("scores_10.parquet",), ("scores_9.parquet",), ("scores.parquet",)], "name string")
    assert [r.name for r in files.manifest_of_names(names).orderBy("place").collect()] == ["scores.parquet", "scores_9.parquet", "scores_10.parquet"]


def test_reports_and_metadata(spark, tmp_path):
    files.write_report(spark.createDataFrame([("one",), ("two",)], "value string").coalesce(1), str(tmp_path / "r"))
    assert [r.value for r in spark.read.text(str(tmp_path / "r")).collect()] == ["one", "two"]
    for n in (3, 4):
        files.write_metadata(spark, str(tmp_path / "m"), n=n, name="x")
    assert spark.read.json(str(tmp_path / "m")).collect()[0].asDict() == {"n": 4, "name": "x"}


def test_failures_are_bounded(spark):
    rows = spark.createDataFrame([(None,)] * 3 + [("bad",)] * 2, "error string")
    got = [rows.agg(selection.fails_past(F.col("error"), most).alias("x")).first().x for most in (1, 2)]
    assert got == [True, False]


def test_new_files_are_scored_once(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    score = lambda batch: batch.withColumn("score", F.col("id") * 2)
    for low, high in ((0, 5), (5, 9), (9, 9)):
        spark.range(low, high).coalesce(1).write.mode("append").parquet(source)
        incremental.score_new_files(spark.readStream.schema("id long").parquet(source), score, out, mark).awaitTermination()
    assert sorted((r.id, r.score) for r in spark.read.parquet(out).collect()) == [(i, 2 * i) for i in range(9)]


def test_log_means(spark, tmp_path):
    rows = [("2024-01-01 00:00:10", "loss", 1.0), ("2024-01-01 00:00:50", "loss", 3.0), ("2024-01-01 00:01:10", "loss", 5.0), ("2024-01-01 00:00:20", "lr", 0.5), ("2024-01-01 01:00:00", "lr", 1.0)]
    log = spark.createDataFrame(rows, "ts string, name string, value double").withColumn("ts", F.to_timestamp("ts"))
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    query = incremental.log_means(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(str(r.window_start), r.name): (r.mean, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("2024-01-01 00:00:00", "loss"): (2.0, 2), ("2024-01-01 00:01:00", "loss"): (5.0, 1), ("2024-01-01 00:00:00", "lr"): (0.5, 1)}
