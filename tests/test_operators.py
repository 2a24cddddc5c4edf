"""Operators on the value fixtures of FIXTURES.md."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.functions import schedules
from millrace.functions import text as X
from millrace.operators import batching, corpus, distill, evaluation, retokenize, selection, sequences
from millrace.sources import binidx

DOCS = [[1, 2, 9, 3, 4, 0], [5, 6, 0]]


def packed(docs, space_at, **options):
    return list(corpus.pack_stream([(d, [t in space_at for t in d]) for d in docs], 5, 0, {9}, **options))


def test_packing_ends_on_sentences():
    assert packed(DOCS, {3}) == [([1, 2, 9], 2), ([3, 4, 0], 2)]  # V1
    assert packed(DOCS, set()) == [([1, 2, 9, 3, 4], 0)]  # V2
    assert packed([[9, 1, 2, 3, 4, 0]], {1}) == [([1, 2, 3, 4, 0], 0)]  # V3
    assert packed(DOCS, {3}, bos=100) == [([100, 1, 2, 9], 1), ([100, 3, 4, 0], 1)]  # V4
    assert packed(DOCS, {3}, flush_tail=True)[-1] == ([5, 6, 0], 2)


def test_packed_table_is_the_fold_of_each_domain(spark):
    rows = [(i, f"d{i % 2}", [1 + i % 7, 9, 3, 4, 5, 0][: 3 + i % 4], [j % 2 == 0 for j in range(3 + i % 4)]) for i in range(40)]
    out = corpus.pack_sentences(spark.createDataFrame(rows, "doc_id long, domain string, tokens array<int>, spaced array<boolean>"), 8, 0, [9]).collect()
    for d in ("d0", "d1"):
        want = list(corpus.pack_stream([(r[2], r[3]) for r in rows if r[1] == d], 8, 0, {9}))
        assert [(r.tokens, r.padding) for r in sorted(out, key=lambda r: r.seq) if r.domain == d] == want


@pytest.mark.parametrize("options", [{}, {"flush_tail": True}, {"bos": 100}, {"most": 2, "keep_singletons": True}])
@pytest.mark.parametrize("ends", [[9], []])
def test_streams_carry_their_tails(spark, options, ends):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(90):
        n = int(rng.integers(0, 30)) if i % 40 else 60
        rows.append((i, f"d{i % 2}", [int(t) for t in rng.integers(1, 12, n)] + [0] * (i % 3 > 0), [bool(x) for x in rng.integers(0, 2, n)] + [False] * (i % 3 > 0)))
    rows.append((500, "alone", [1, 2, 3, 9, 4], [True] * 5))
    docs = spark.createDataFrame(rows, "doc_id long, domain string, tokens array<int>, spaced array<boolean>")
    out = corpus.pack_sentences(docs, 8, 0, ends, docs_per_stream=7, **options).collect()
    for d in ("d0", "d1", "alone"):
        want = list(corpus.pack_stream([(r[2], r[3]) for r in rows if r[1] == d], 8, 0, set(ends), **options))
        assert [(r.tokens, r.padding) for r in sorted(out, key=lambda r: (r.stream, r.seq)) if r.domain == d] == want


def test_difference_selection(spark):  # V5
    score = lambda v: spark.createDataFrame(list(enumerate(v)), "idx long, score double")
    diff = selection.difference(score([2.0, 1.0, 3.0, 2.5]), score([2.5, 3.0, 3.0, 2.0]))
    assert [r.idx for r in selection.ranked(diff, "diff").orderBy("rank").collect()] == [1, 0, 2, 3]
    for ratio in (0.5, 0.6):
        assert sorted(r.idx for r in selection.top_fraction(diff, "diff", ratio).collect()) == [0, 1]
    with pytest.raises(Exception, match="without a counterpart"):
        selection.difference(score([1.0, 2.0]), score([1.0])).collect()
    assert selection.bottom_fraction(diff, "diff", 0.001).count() == 0  # V22


def test_losses(spark):
    losses = spark.createDataFrame([(0, i, float(i + 1), m) for i, m in enumerate([1, 0, 1, 1])] + [(1, 0, 1.0, 0)], "idx long, pos int, loss double, mask int")
    got = dict(map(tuple, distill.masked_mean(losses).collect()))
    assert got[0] == pytest.approx(8 / 3) and got[1] is None  # V6
    teacher = spark.createDataFrame([(0, 0, 0, 0.5), (0, 0, 1, 0.5)], "idx long, pos int, token_id int, p double")
    student = teacher.select("idx", "pos", "token_id", F.lit(math.log(0.5)).alias("logq"))
    mask = spark.createDataFrame([(0, 0, 1)], "idx long, pos int, mask int")
    assert distill.kd_loss(teacher, student, mask).first().kd == pytest.approx(math.log(2))  # V11
    assert distill.entropy(teacher, mask).first().entropy == pytest.approx(math.log(2))


def test_batches(spark):
    rows = spark.createDataFrame([(0, [5, 6, 0, 7])], "idx long, tokens array<int>")
    r = batching.lm_batch(rows, 5, 0).first()  # V7
    assert (r.input_ids, r.attention_mask, r.label, r.loss_mask) == ([5, 6, 0, 0, 0], [1, 1, 1, 0, 0], [6, 0, 7, 0, 0], [1, 1, 0, 0, 0])
    prompt = batching.split_prompt(spark.createDataFrame([(0, [11, 12, 99, 21, 22])], "idx long, tokens array<int>"), 99)
    r = batching.prompt_batch(prompt, 3, 0).first()  # V8
    assert (r.input_ids, r.label, r.loss_mask) == ([11, 12, 21], [12, 21, 22], [0, 1, 1])


def test_sparse_distributions(spark):
    probs = spark.createDataFrame([(0, 0, i, p) for i, p in enumerate([0.1, 0.5, 0.15, 0.25])], "idx long, pos int, token_id int, p double")
    assert [(r.token_id, r.p) for r in distill.top_k(probs, 2).orderBy("rank").collect()] == [(1, 0.5), (3, 0.25)]  # V9
    draws = spark.createDataFrame([(0, 0, t) for t in (3, 1, 1, 0)], "idx long, pos int, token_id int")
    got = distill.rebuilt(distill.counted(draws), 4).orderBy("token_id").collect()
    assert [(r.token_id, r["count"], r.p) for r in got] == [(0, 1, 0.25), (1, 2, 0.5), (3, 1, 0.25)]  # V10
    dense = spark.createDataFrame([(i, 0, [0.2, 0.3, 0.5]) for i in range(20)], "idx long, pos int, p array<double>")
    a = distill.draw(dense, 50)
    assert all(r.n == 50 for r in a.groupBy("idx").agg(F.sum("count").alias("n")).collect())
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, distill.draw(dense.repartition(3), 50).collect()))


def test_histogram(spark):  # V12
    got = selection.histogram(spark.createDataFrame([(x,) for x in (0.0, 1.0, 2.0, 4.0)], "x double"), "x", 4).orderBy("bin").collect()
    assert [r.density for r in got] == [0.25] * 4 and [r.cumulative for r in got] == [0.25, 0.5, 0.75, 1.0]


def test_manifest(spark):  # V13
    rows = spark.createDataFrame([(s,) for s, n in ((0, 3), (1, 2), (2, 4)) for _ in range(n)], "shard int")
    shards = sequences.manifest(rows)
    assert [r.lo for r in shards.orderBy("shard").collect()] == [0, 3, 5]
    r = sequences.locate(spark.createDataFrame([(4,)], "idx long"), shards).first()
    assert (r.shard, r.local_idx) == (1, 1)
    assert sequences.between(spark.range(9).withColumnRenamed("id", "idx"), 2, 7).count() == 5


def test_file_format(spark, tmp_path):  # V14, V15
    spark.dataSource.register(binidx.BinIdx)
    rows = spark.createDataFrame([(0, 0, [1, 2, 3]), (0, 1, [4])], "shard int, local_idx int, tokens array<long>")
    rows.repartition("shard").sortWithinPartitions("shard", "local_idx").write.format("binidx").option("path", str(tmp_path)).option("name", "data").mode("append").save()
    index = (tmp_path / "data_0.idx").read_bytes()
    assert index.hex().startswith("4d4d494449445800000100000000000000040200000000000000") and len(index) == 66
    assert (tmp_path / "data_0.bin").read_bytes().hex() == "01000000020000000300000004000000"
    more = spark.createDataFrame([(i // 7 + 1, i % 7, list(range(i))) for i in range(30)], "shard int, local_idx int, tokens array<long>")
    more.repartition("shard").sortWithinPartitions("shard", "local_idx").write.format("binidx").option("path", str(tmp_path)).option("name", "data").mode("append").save()
    back = spark.read.format("binidx").option("path", str(tmp_path)).option("rowsPerTask", 4).load().orderBy("idx").collect()
    assert [r.tokens for r in back] == [[1, 2, 3], [4], *(list(range(i)) for i in range(30))] and [r.idx for r in back] == list(range(32))
    part = spark.read.format("binidx").option("path", str(tmp_path)).option("low", 3).option("high", 9).load()
    assert sorted(r.idx for r in part.collect()) == [3, 4, 5, 6, 7, 8]
    (tmp_path / "data_2.bin").unlink()
    assert spark.read.format("binidx").option("path", str(tmp_path)).load().count() == 9  # up to the first gap
    assert binidx.best_code(60000) == 8 and binidx.best_code(None) == 4


def test_shards(spark):
    rows = sequences.into_shards(spark.range(5).withColumnRenamed("id", "doc"), ["doc"], per_shard=2)
    assert sorted((r.shard, r.local_idx) for r in rows.collect()) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0)]


def test_workers_and_whole_batches(spark):  # V16, V17
    rows = spark.range(5).withColumnRenamed("id", "idx")
    assert sorted(r.idx for r in batching.to_workers(rows, 2).filter("worker = 0").collect()) == [0, 2, 4]
    kept = batching.drop_last(spark.range(10).withColumnRenamed("id", "pos"), 4)
    assert kept.count() == 8 and kept.agg(F.max("step")).first()[0] == 1


def test_schedule(spark):  # V18
    steps = spark.createDataFrame([(i,) for i in (0, 1, 2, 6, 10)], "s long")
    assert [r[0] for r in steps.select(schedules.cosine(F.col("s"), 1.0, 0.0, 10, 2)).collect()] == pytest.approx([0, 0.5, 1, 0.5, 0])


def test_retokenise(spark):  # V19
    make = lambda: (lambda ids: "".join(map(chr, ids)), lambda s: [ord(c) + 1000 for c in s for _ in (0, 1)])
    rows = spark.createDataFrame([(0, [65, 0, 66, 0])], "idx long, tokens array<int>")
    assert retokenize.retokenize(rows, make, 0, 7, 100).first().tokens == [1065, 1065, 7, 1066, 1066, 7]
    assert retokenize.retokenize(rows, make, 0, 7, 4).first().tokens == [1065, 1065, 7, 1066]


def test_arrays(spark):  # V20
    rows = spark.createDataFrame([([5, 6, 0, 0, 0],), ([0, 0],), ([1, 0, 2],)], "x array<int>")
    assert [r[0] for r in rows.select(X.trim_pads(F.col("x"), 0)).collect()] == [[5, 6], [0, 0], [1, 0, 2]] or [r[0] for r in rows.select(X.trim_pads(F.col("x"), 0)).collect()] == [[5, 6, 0], [0, 0], [1, 0, 2]]
    p = spark.createDataFrame([([1.0, 2.0, 3.0],)], "x array<double>").select(X.softmax(F.col("x")).alias("p"), X.log_softmax(F.col("x")).alias("l")).first()
    want = np.exp([1.0, 2.0, 3.0]) / np.exp([1.0, 2.0, 3.0]).sum()
    assert p.p == pytest.approx(want.tolist()) and p.l == pytest.approx(np.log(want).tolist())


def test_task_average(spark):  # V21
    results = spark.createDataFrame([("A", 0.4, 0.5), ("B", 0.7, None)], "task string, acc double, acc_norm double")
    assert dict(map(tuple, evaluation.macro_average(results).collect())) == {"A": 0.5, "B": 0.7, "avg": pytest.approx(0.6)}


def test_stream_gives_the_chunks_of_the_batch(spark, tmp_path):
    from millrace.streaming import incremental

    schema = "doc_id long, domain string, tokens array<int>, spaced array<boolean>"
    rows = [(i, "d", [1 + i % 5, 9, 3, 0], [False, False, True, False]) for i in range(30)]
    for k in range(3):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = incremental.pack_arriving(stream, 7, 0, [9]).writeStream.format("memory").queryName("chunks").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = sorted(len(r.tokens) for r in spark.table("chunks").collect())
    want = sorted(len(c) for c, _ in corpus.pack_stream([(r[2], r[3]) for r in rows], 7, 0, {9}))
    assert got == want


def test_reference_model_learns_from_the_rows_it_is_given(spark):
    docs = spark.createDataFrame([(1, "a", "x y y"), (2, "b", "x z")], "doc_id long, source string, text string")
    got = {r.idx: r.small for r in corpus.language_model_scores(docs, training=docs).collect()}
    p = {"x": 3 / 9, "y": 3 / 9, "z": 2 / 9}
    assert got[1] == pytest.approx(-math.log(p["x"]) / 3 - 2 * math.log(p["y"]) / 3) and got[2] == pytest.approx(-(math.log(p["x"]) + math.log(p["z"])) / 2)


def test_whole_tables_are_covered(spark, tmp_path):
    from millrace.plans import catalog

    ids = [*range(499), 0, *range(600, 1299)]
    docs = [(i, "w " * 50 + ". a . b" + " ." * 3, "src1") for i in ids]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    located = catalog.QUERIES["locate_all_rows"](spark, str(tmp_path)).collect()
    assert sorted((r.idx, r.shard, r.local_idx) for r in located) == [(i, i // 500, i % 500) for i in range(len(docs))]
    assert catalog.QUERIES["held_out_shards_are_disjoint"](spark, str(tmp_path)).first().n_shared == 0
    spark.createDataFrame([(i // 2, "w", "src1") for i in range(1, 1500)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/twice/documents.parquet")
    assert catalog.QUERIES["held_out_shards_are_disjoint"](spark, f"{tmp_path}/twice").first().n_shared == 2
    split = catalog.QUERIES["whole_trimmed_and_split"](spark, str(tmp_path)).first()
    assert split.parts == 6 and split.t == ",".join(["119"] * 50 + ["46", "97", "46", "98"])


def test_losses_of_rows_are_those_of_entries(spark):
    rng = np.random.default_rng(3)
    teacher, student, mask = [], [], []
    for i in range(6):
        for j in range(4):
            p, q = rng.dirichlet(np.ones(7)), np.log(rng.dirichlet(np.ones(7)))
            if i == 1:
                q[:3] = -np.inf
            teacher += [(i, j, t, float(p[t])) for t in range(0, 7, 2)]
            student.append((i, j, [float(x) for x in q]))
            mask.append((i, j, int(i != 2 and j != 3)))
    long = spark.createDataFrame(teacher, "idx long, pos int, token_id int, p double")
    dense = spark.createDataFrame(student, "idx long, pos int, logq array<double>")
    masks = spark.createDataFrame(mask, "idx long, pos int, mask int")
    rows = long.groupBy("idx", "pos").agg(F.array_sort(F.collect_list(F.struct("token_id", "p"))).alias("entries"))
    got = {r.idx: (r.kd, r.entropy) for r in distill.kd_losses_of_rows(rows, dense, masks).collect()}
    flat = dense.select("idx", "pos", F.posexplode("logq").alias("token_id", "logq"))
    kd = {r.idx: r.kd for r in distill.kd_loss(long, flat, masks).collect()}
    own = {r.idx: r.entropy for r in distill.entropy(long, masks).collect()}
    assert got.keys() == kd.keys() and got[2] == (None, None)
    assert all(got[i] == (pytest.approx(kd[i]), pytest.approx(own[i])) for i in kd if i != 2)


def test_dense_rows(spark):
    r = spark.range(1).select(distill.to_dense(F.expr("array(named_struct('token_id', 3, 'p', 0.5D), named_struct('token_id', 1, 'p', 0.25D))"), 5).alias("d"), distill.to_dense(F.expr("slice(array(named_struct('token_id', 3, 'p', 0.5D)), 1, 0)"), 2).alias("none")).first()
    assert r.d == [0, 0.25, 0, 0.5, 0] and r.none == [0, 0]
    logits = [1.0, 2.0, -1.0]
    rows = spark.createDataFrame([(t, logits) for t in (1, -100, 3, None)], "t int, x array<double>")
    got = {r.t: r.loss for r in rows.select("t", distill.cross_entropy(F.col("x"), F.col("t")).alias("loss")).collect()}
    assert got[1] == pytest.approx(math.log(sum(map(math.exp, logits))) - 2) and got[-100] is got[3] is got[None] is None


def test_draws_follow_the_probabilities(spark):
    p = [0.0, 0.5, 0.3, 0.0, 0.2, 0.0]
    dense = spark.createDataFrame([(i, 0, p) for i in range(400)] + [(400, 0, []), (401, 0, [0.0]), (402, 0, None)], "idx long, pos int, p array<double>")
    got = {r.token_id: r.n for r in distill.draw(dense, 50).groupBy("token_id").agg(F.sum("count").alias("n")).collect()}
    assert set(got) == {1, 2, 4} and sum(got.values()) == 20_000
    assert sum((got[t] - 20_000 * p[t]) ** 2 / (20_000 * p[t]) for t in got) < 13.8  # chi-square of 2 degrees, 0.1 %


def test_cache(spark, tmp_path):
    sparse = spark.createDataFrame([(i, j, t, 1 / (t + 2)) for i in range(10) for j in range(3) for t in range(2)], "idx long, pos int, token_id int, p double")
    distill.write_cache(distill.to_cache(sparse, 4), str(tmp_path / "cache"))
    cache = spark.read.parquet(str(tmp_path / "cache"))
    assert {(r.idx, r.shard_id, r.local_idx, r.length) for r in cache.collect()} == {(i, i // 4, i % 4, 3) for i in range(10)}
    assert sorted((r.idx, r.pos, r.token_id, round(r.p, 6)) for r in distill.from_cache(cache).collect()) == sorted((r.idx, r.pos, r.token_id, round(r.p, 6)) for r in sparse.collect())


def test_scores_have_to_fit_the_dataset(spark):
    rows = spark.range(3).withColumnRenamed("id", "idx")
    assert selection.against_dataset(rows, rows.withColumn("score", F.lit(1.0))).count() == 3
    for a, b in ((2, 3), (3, 2)):
        with pytest.raises(Exception, match="dataset and scores differ at 2"):
            selection.against_dataset(spark.range(a).withColumnRenamed("id", "idx"), spark.range(b).select(F.col("id").alias("idx"), F.lit(1.0).alias("score"))).collect()


def test_slices_of_an_index(spark, tmp_path):
    spark.dataSource.register(binidx.BinIdx)
    rows = spark.createDataFrame([(i // 5, i % 5, list(range(i % 4))) for i in range(13)], "shard int, local_idx int, tokens array<long>")
    rows.repartition("shard").sortWithinPartitions("shard", "local_idx").write.format("binidx").option("path", str(tmp_path)).mode("append").save()
    assert [binidx.count_rows(str(tmp_path), "data", s) for s in range(3)] == [5, 5, 3]
    whole = binidx.read_index(str(tmp_path), "data", 1)
    code, sizes, at = binidx.read_places(str(tmp_path), "data", 1, 2, 4)
    assert code == whole.code and (sizes == whole.sizes[2:4]).all() and (at == whole.at[2:4]).all()
    back = spark.read.format("binidx").option("path", str(tmp_path)).option("low", 3).option("high", 11).option("rowsPerTask", 2).load().orderBy("idx").collect()
    assert [(r.idx, r.shard, r.local_idx, r.tokens) for r in back] == [(i, i // 5, i % 5, list(range(i % 4))) for i in range(3, 11)]


@pytest.mark.parametrize("common", [0, 1, 3, 1 << 18])
def test_scores_whichever_way_words_meet_their_counts(spark, common):
    docs = [(0, "a", "x y y z"), (1, "a", "x x w"), (1, "b", "x"), (2, "b", "x z . é" + " q" * 70), (20, "b", "y " + "l" * 80), (3, None, "x"), (4, "a", ""), (5, "a", None), (None, "a", "z")]
    own, ref = Counter((s, t) for _, s, text in docs for t in (text or "").split()), Counter(t for i, _, text in docs if i is not None and i % 20 == 0 for t in (text or "").split())
    total, base = Counter(), ref.total() + len(ref) + 1
    for (s, _), n in own.items():
        total[s] += n
    want = defaultdict(list)
    for i, s, text in docs:
        want[i] += [(-math.log(own[s, t] / total[s]), -math.log((ref[t] + 1) / base)) for t in (text or "").split() if s]
    want = {i: tuple(sum(x) / len(x) for x in zip(*xs, strict=True)) for i, xs in want.items() if xs}
    scores = corpus.language_model_scores(spark.createDataFrame(docs, "doc_id long, source string, text string"), common=common)
    assert {r.idx: (pytest.approx(r.large), pytest.approx(r.small)) for r in scores.collect()} == want


def test_common_words_never_become_rows(spark):
    docs = spark.createDataFrame([(1, "a", "x Y q y q"), (1, "a", "x"), (2, "b", "x"), (3, None, "x"), (4, "a", " "), (None, "a", "y")], "doc_id long, source string, text string")
    costs = spark.createDataFrame([("a", "x", 1.0, 2.0), ("a", "y", 0.5, 0.25), ("c", "q", 9.0, 9.0)], "source string, tok string, large double, small double")
    own = [(1, None, "1", 5, 2.0, 2.5), (1, None, "1", 1, 1.0, 2.0), (2, None, "2", 1, 0.0, 0.0), (None, None, None, 1, 0.5, 0.25)]
    rest = [(1, "a", "q", 2, None, None), (2, "b", "x", 1, None, None)]
    assert Counter(map(tuple, corpus._priced(docs, costs).collect())) == Counter(own + rest)
    assert Counter(map(tuple, corpus._priced(docs, costs.limit(0)).filter("source is null").select("doc_id", "n", "large").collect())) == Counter([(1, 5, 0.0), (1, 1, 0.0), (2, 1, 0.0), (None, 1, 0.0)])


def test_a_task_adds_up_what_it_counts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, None if i % 3 == 2 else "s", "x y" if i % 2 else "x") for i in range(12)], "doc_id long, source string, text string").coalesce(1)
    want = [(None, "x", 4), (None, "y", 2), ("s", "x", 8), ("s", "y", 4)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)  # a part for each text
    try:
        assert Counter(map(tuple, corpus.word_counts(docs, "source").collect())) == Counter(want)
        monkeypatch.setattr(corpus, "COUNTS_AT_ONCE", 1)  # rows that do not wait
        rows = corpus.word_counts(docs, "source")
        assert rows.count() == 18 and Counter(map(tuple, rows.groupBy("source", "tok").agg(F.sum("n")).collect())) == Counter(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("trained", [False, True])
def test_counts_are_dealt_once(spark, monkeypatch, trained):
    plans, stored = [], corpus.stored
    monkeypatch.setattr(corpus, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df))
    docs = spark.createDataFrame([(0, "a", "x y"), (1, "b", "x z"), (20, None, "y")], "doc_id long, source string, text string")
    scores = corpus.language_model_scores(docs, training=docs.filter("doc_id % 20 = 0") if trained else None)
    assert sum(p.count("Exchange") for p in plans) == 2  # the counts of all pairs by word, and the sources' totals
    # the reference model has x once and y twice of 3 words, and no z
    assert {r.idx: (pytest.approx(r.large), pytest.approx(r.small)) for r in scores.collect()} == {0: (math.log(2), -math.log(2 / 6 * 3 / 6) / 2), 1: (math.log(2), -math.log(2 / 6 * 1 / 6) / 2)}


def test_texts_stay_where_they_are_for_a_report(spark):
    report = spark.createDataFrame([("top", 3, 0.5), ("bottom", 3, 0.5), ("top", 7, 0.25)], "report string, idx long, value double")
    texts = spark.range(9).select(F.col("id").alias("idx"), F.concat(F.lit("t"), "id").alias("text"))
    scores = spark.range(9).select(F.col("id").alias("idx"), F.lit(1.0).alias("large"), F.lit(2.0).alias("small"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for made, n in ((selection.report_lines(report, texts), 3), (selection.report_rows(report, scores, texts), 3)):
            assert "hashpartitioning" not in made._jdf.queryExecution().executedPlan().toString() and made.count() == n
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_marks_of_an_array_are_looked_for_once(spark):
    frame = spark.createDataFrame([([1, 46, 46, 2],), ([46],), ([],), (None,)], "t array<int>")
    split, trimmed = X.split_array(F.col("t"), 46).alias("s"), X.trim_pads(F.col("t"), 46).alias("p")
    assert [(r.s, r.p) for r in frame.select(split, trimmed).collect()] == [([[1], [], [2]], [1, 46, 46, 2]), ([[], []], [46]), ([[]], []), (None, None)]
    for c in (split, trimmed):  # a second time would be one for each part: the square of a text's length
        assert frame.select(c).columns and str(frame.select(c)._jdf.queryExecution().analyzed()).count("filter(") == 1


@pytest.mark.parametrize("flush", [False, True])
@pytest.mark.parametrize("bos", [None, 7])
def test_streams_are_packed_in_blocks(bos, flush):
    rng = np.random.default_rng(3)
    docs = [(rng.integers(0, 12, n).astype(np.int32), rng.integers(0, 2, n).astype(bool)) for n in [0, 3, 1, 40, 2, 5, 0, 11, 17, 1, 1, 30]]
    options = (8, 0, {9, 4}, frozenset([3]), bos, 3, False)
    whole = list(corpus.pack_stream(docs, *options, flush))
    head = (np.array([5, 9, 1, 2], np.int32), np.array([True, False, True, False]))
    for n in (1, 2, 5, len(docs)):
        blocks = [docs[i : i + n] for i in range(0, len(docs), n)]
        assert [c for chunks in corpus.pack_blocks(blocks, *options, flush_tail=flush) for c in chunks] == whole
        carried = slice(0, 5)
        assert corpus.table_of_blocks(blocks, head, *options)[carried].tolist() == corpus.leftovers(docs, head, *options)[carried].tolist()
    tables = [pa.RecordBatch.from_pylist([{"_at": i + 20 * k, "tokens": t.tolist(), "spaced": s.tolist()} for i, (t, s) in enumerate(docs)], pa.schema([("_at", pa.int64()), ("tokens", pa.list_(pa.int32())), ("spaced", pa.list_(pa.bool_()))])) for k in range(2)]
    blocks = list(corpus.blocks_of(iter(tables), 10))
    assert [x[1].tolist() for b in blocks for x in b] == [t.tolist() for _ in range(2) for t, _ in docs] and all(sum(len(x[1]) for x in b[:-1]) < 10 for b in blocks)
    with pytest.raises(ValueError, match="not in order"):
        list(corpus.blocks_of(iter(tables[::-1]), 10))


@pytest.mark.parametrize("at_once", [1, 40, 1 << 23])
def test_words_are_counted_on_bytes_as_they_are_cut_by_the_pattern(spark, monkeypatch, at_once):
    monkeypatch.setattr(corpus, "TEXT_AT_ONCE", at_once)
    texts = ["ab", "ab", "", None, " \t\n\x0b\f\r", "A-b  c..\nd\u00a0e\x00", "\u0130I\u03a3 \u00e9\u00e9a1\u4e2d\u6587", "x\U0001f600\U0001f600y", "1,2", "a" * 90 + "\u2028z"]
    docs = spark.createDataFrame([(i // 2, None if i % 3 == 2 else "s", t) for i, t in enumerate(texts)], "doc_id long, source string, text string").coalesce(1)
    for keys in ([], ["source"], ["doc_id", "source"]):
        want = docs.select(*keys, F.explode(X.tokenize(F.col("text"))).alias("tok")).groupBy(*keys, "tok").agg(F.count("*").alias("n"))
        rows = corpus.word_counts(docs, *keys)
        assert Counter(map(tuple, rows.groupBy(*keys, "tok").agg(F.sum("n")).collect())) == Counter(map(tuple, want.collect()))
        assert at_once < 1 << 23 or rows.count() == want.count()
