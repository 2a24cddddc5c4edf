"""Tables that meet in place, packing from SQL, ordered parts of a corpus."""

import json
import math
import os
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import corpus, distill, evaluation, udtf
from millrace.sources import files


def sequences(seed=0):
    """Cached entries and a student's rows of sequences of several positions; some are not cached, some masked out."""
    rng = np.random.default_rng(seed)
    entries, student = [], []
    for i in range(30):
        n = int(rng.integers(1, 5))
        mask = [int(x) for x in rng.integers(0, 2, n)] if i % 5 else [0] * n
        logq = [[float(x) if x < 2 else float("-inf") for x in rng.normal(size=6)] for _ in range(n)]
        student.append((i, logq, mask))
        if i % 7:
            entries += [(i, p, int(t), float(w)) for p in range(n) for t, w in zip(rng.choice(6, 3, replace=False), rng.dirichlet(np.ones(3)), strict=True)]
    return entries, student


def test_cached_losses_without_a_shuffle(spark):
    entries, student = sequences()
    cache = distill.co_located(distill.to_cache(spark.createDataFrame(entries, "idx long, pos int, token_id int, p double"), 64), "cache", 4)
    rows = distill.co_located(spark.createDataFrame(student, "idx long, logq array<array<double>>, mask array<int>"), "student", 4)
    losses = distill.cached_losses(cache, rows)
    plan = losses._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    by = defaultdict(lambda: defaultdict(list))
    for i, p, t, w in entries:
        by[i][p].append((t, float(np.float32(w))))
    got = {r.idx: (r.kd, r.entropy) for r in losses.collect()}
    assert len(got) == 30
    for i, logq, mask in student:
        if i not in by or not sum(mask):
            assert got[i] == (None, None)
            continue
        term = lambda p, of: sum(w * (0 if math.isinf(of(t, w)) else of(t, w)) for t, w in by[i][p])  # noqa: B023, E731
        kd = -sum(m * term(p, lambda t, _: logq[p][t]) for p, m in enumerate(mask)) / sum(mask)  # noqa: B023
        entropy = -sum(m * term(p, lambda _, w: math.log(w)) for p, m in enumerate(mask)) / sum(mask)
        assert got[i] == (pytest.approx(kd), pytest.approx(entropy))
    long = spark.createDataFrame([(i, p, t, x) for i, logq, _ in student for p, q in enumerate(logq) for t, x in enumerate(q)], "idx long, pos int, token_id int, logq double")
    mask = spark.createDataFrame([(i, p, m) for i, _, ms in student for p, m in enumerate(ms)], "idx long, pos int, mask int")
    whole = {r.idx: r.kd for r in distill.kd_loss(distill.from_cache(cache), long, mask).collect()}
    assert all(whole[i] == (pytest.approx(got[i][0]) if got[i][0] is not None else None) for i in by)


def encoded(spark):
    rng = np.random.default_rng(3)
    docs = [(i, f"d{i % 3}" if i % 11 else None, [int(x) for x in rng.integers(1, 40, rng.integers(0, 50))]) for i in range(90)]
    return docs, spark.createDataFrame([(i, d, t, [x % 2 == 0 for x in t]) for i, d, t in docs], "doc_id long, domain string, tokens array<int>, spaced array<boolean>")


@pytest.mark.parametrize("flush", [False, True])
def test_packing_from_sql(spark, flush):
    docs, frame = encoded(spark)
    udtf.register(spark)
    frame.repartition(5).createOrReplaceTempView("some_docs")
    got = spark.sql(f"select * from pack_sentences(table(some_docs) partition by domain order by (doc_id), 32, 0, array(7, 9, 13), array(11), {str(flush).lower()})")
    by = defaultdict(list)
    for _, d, t in docs:
        by[d].append((t, [x % 2 == 0 for x in t]))
    want = {(d, i): (c, p) for d, rows in by.items() for i, (c, p) in enumerate(corpus.pack_stream(rows, 32, 0, {7, 9, 13}, frozenset([11]), flush_tail=flush))}
    assert {(r.domain, r.seq): (r.tokens, r.padding) for r in got.collect()} == want
    assert spark.sql("select * from pack_sentences(table(select * from some_docs where false) partition by domain order by (doc_id), 32, 0, array(7), array(11))").count() == 0
    with pytest.raises(Exception, match="no column spaced"):
        spark.sql("select * from pack_sentences(table(select domain, tokens from some_docs) partition by (domain), 32, 0, array(7), array(11))")
    with pytest.raises(Exception, match="two tokens"):
        spark.sql("select * from pack_sentences(table(some_docs) partition by (domain), 1, 0, array(7), array(11))")


def parts(tmp_path):
    """Three files and a folder of two, of 1 to 5 documents each."""
    for k, n in enumerate((3, 1, 5)):
        (tmp_path / f"file {k}.json").write_text("".join(json.dumps({"text": f"{k}:{i}", "meta": {"pile_set_name": "x"}}) + "\n" for i in range(n)))
    (tmp_path / "folder").mkdir()
    for j in range(2):
        (tmp_path / "folder" / f"part-{j}.json").write_text(json.dumps({"text": f"f:{j}", "meta": None}) + "\n")
    (tmp_path / "_SUCCESS").write_text("")
    (tmp_path / ".hidden").write_text("no json")


def test_ranges_of_an_ordered_list(spark, tmp_path):
    parts(tmp_path)
    order = files.file_list(spark, str(tmp_path), saved=str(tmp_path / "_list"))
    names = [os.path.basename(f) for f in order]
    assert sorted(names) == ["file 0.json", "file 1.json", "file 2.json", "folder"] and files.file_list(spark, str(tmp_path), seed=233) == order
    assert any(files.file_list(spark, str(tmp_path), seed=s) != order for s in range(5))
    (tmp_path / "later.json").write_text("")
    assert files.file_list(spark, str(tmp_path), saved=str(tmp_path / "_list")) == order
    held = {"file 0.json": 3, "file 1.json": 1, "file 2.json": 5, "folder": 2}
    for a, b in ((0, 1), (1, 3), (2, None), (0, None)):
        chosen = files.corpus_of(spark, order, a, b)
        assert {r.place: r.n for r in chosen.groupBy("place").agg(F.count("*").alias("n")).collect()} == {i: held[n] for i, n in list(enumerate(names))[a:b]}
        assert {f.split("/")[-1] if "/folder/" not in f else "folder" for f in (x.replace("%20", " ") for x in chosen.inputFiles())} == set(names[a:b])
    assert files.corpus_of(spark, order, 4).count() == 0


def test_no_more_parts_than_are_needed(spark, tmp_path, monkeypatch):
    parts(tmp_path)
    order = files.file_list(spark, str(tmp_path))
    held = [files.corpus_of(spark, order, i, i + 1).count() for i in range(4)]
    opened, corpus_of = [], files.corpus_of
    monkeypatch.setattr(files, "corpus_of", lambda spark, parts, a, b: opened.append((a, b)) or corpus_of(spark, parts, a, b))
    for needed in range(13):
        n = next((k for k in range(5) if sum(held[:k]) >= needed), 4)
        assert files.enough_parts(spark, order, needed) == (n, held[:n])
    opened.clear()
    files.enough_parts(spark, order, held[0])
    assert opened == [(0, 1)]
    assert files.enough_parts(spark, order, 10**6, F.length("text"))[0] == 4


def test_evaluations_of_a_step_are_replaced(spark, tmp_path):
    path = str(tmp_path)
    for offset in (0, 100):
        preds = spark.range(6).select(F.when(F.lit(offset) == 0, F.col("id") % 3).otherwise(F.lit(1)).alias("step"), (F.col("id") + offset).alias("pred"))
        evaluation.write_evals(preds, preds.groupBy("step").agg(F.max("pred").alias("best")), path)
    preds, results = evaluation.read_evals(spark, path)
    assert {(r.step, r.best) for r in results.collect()} == {(0, 3), (1, 105), (2, 5)} and sorted(r.pred for r in preds.collect()) == [0, 2, 3, 5, 100, 101, 102, 103, 104, 105]


def test_labels_by_first_token(spark):
    rows = spark.createDataFrame([(0, ["yes", "no"]), (1, ["yes sir"]), (2, ["no"]), (3, [""]), (4, []), (5, None)], "idx long, output array<string>")
    got = {r.token: r.answer for r in evaluation.label_map(rows, F.get(F.split("answer", " "), F.lit(0))).collect()}
    assert got == {"yes": "yes sir", "no": "no", "": ""}


def test_capped_rows(spark):
    rows = spark.range(5).withColumnRenamed("id", "idx")
    assert [evaluation.capped(rows, n).count() for n in (None, 2, 9)] == [5, 2, 5]
    with pytest.raises(ValueError, match="no rows"):
        evaluation.capped(rows, 0)


def test_means_at_checkpoints(spark):
    log = spark.createDataFrame([(s, "loss", float(s)) for s in (0, 1, 10, 11, 20, 25)], "step long, name string, value double")
    assert sorted(map(tuple, evaluation.at_checkpoints(log, 10).collect())) == [(10, "loss", 11 / 3, 3), (20, "loss", 15.5, 2)]
    assert evaluation.at_checkpoints(log.limit(0), 10).count() == 0


def test_log_lines_print_the_exact_value(spark):
    values = [k / 80000 + 64 for k in range(1, 200, 2)] + [0.5, 1.00005, 2.00015, -3.00025, 123456789.03125, float("inf"), -float("inf")]
    log = spark.createDataFrame([(i, "m", v) for i, v in enumerate(values)], "step long, name string, value double")
    assert {r.step: r.line for r in evaluation.log_lines(log).collect()} == {i: "m: %.4f" % v for i, v in enumerate(values)}
    odd = spark.createDataFrame([(1, "a", 1.0), (1, "a!", 2.0), (1, None, 3.0), (1, "b", None), (2, "a", None), (3, "a", float("nan"))], "step long, name string, value double")
    assert {r.step: r.line for r in evaluation.log_lines(odd).collect()} == {1: "a: 1.0000 | a!: 2.0000", 2: None, 3: "a: nan"}


def test_means_do_not_depend_on_the_tasks(spark):
    values = [1e16, 1.0, -1e16, 3.0, None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)][::-1], "at long, v double").repartition(3)
    assert rows.agg(evaluation.ordered_mean("v", "at").alias("m")).first().m == (((1e16 + 1.0) - 1e16) + 3.0) / 4
    assert rows.filter("v is null").groupBy("at").agg(evaluation.ordered_mean("v", "at").alias("m")).first().m is None


def test_folders_of_steps_are_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(40).select(F.col("id").alias("step"), F.lit("m").alias("name"), F.lit(1.0).alias("mean"))
    evaluation.write_evals(rows, rows, str(tmp_path))
    files_ = list(tmp_path.glob("eval/preds/step=*/part-*.parquet"))
    assert len(files_) == 40 and len({f.name[:10] for f in files_}) > 1
