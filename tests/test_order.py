"""Global order: ranges of tied keys, and permutations by arithmetic."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import corpus, order, selection, shuffle


def counts(df, name="_range"):
    return [r["count"] for r in df.groupBy(name).count().collect()]


@pytest.mark.parametrize("share", [1.0, 0.5, 0.0])
def test_tied_keys_are_cut_by_the_next_one(spark, share):
    """A key that many rows share is in several ranges, in the order of the second column."""
    n = 8000
    rows = spark.range(n).select(F.when(F.col("id") % 100 < int(100 * share), F.lit(5.0)).otherwise((F.col("id") % 17).cast("double")).alias("k"), ((F.col("id") * 7919) % n).alias("idx"))
    cut = order.ranges(rows, F.col("k"), n=8, then=F.col("idx"))
    assert max(counts(cut)) <= 1.5 * n / 8
    edges = cut.groupBy("_range").agg(F.min(F.struct("k", "idx")).alias("a"), F.max(F.struct("k", "idx")).alias("b")).orderBy("_range").collect()
    assert all(tuple(x.b) < tuple(y.a) for x, y in zip(edges, edges[1:], strict=False))
    got = [(r.k, r.idx) for r in order.row_number(rows, ["k", "idx"], "place", n=8).orderBy("place").collect()]
    assert got == sorted(got) and len(got) == n


def test_ranks_of_equal_scores(spark):
    scores = spark.range(5000).select(F.col("id").alias("idx"), F.lit(0.25).alias("v"))
    ranked = selection.ranked(scores, "v")
    assert ranked.filter("rank = idx").count() == 5000


@pytest.mark.parametrize("kind", ["string", "double", "timestamp", "int"])
def test_sums_before_a_row(spark, kind):
    rng = np.random.default_rng(2)
    rows = [(int(k) if k < 6 else None, int(i), int(v)) for i, (k, v) in enumerate(zip(rng.integers(0, 7, 400), rng.integers(0, 9, 400), strict=True))]
    frame = spark.createDataFrame(rows, "k int, idx int, v int").withColumn("k", F.col("k").cast(kind) if kind != "timestamp" else F.timestamp_seconds("k"))
    if kind == "string":
        frame, first = frame.withColumn("n", F.length("k")), "n"
    else:
        first = "k"
    got = order.prefix_sum(frame, F.col("v").cast("long"), [first, "idx"], "before", n=5).select("idx", "before").collect()
    key = {i: (k is not None if kind == "string" else k is not None, 0 if kind == "string" else k or 0, i) for k, i, _ in rows}
    want, total = {}, 0
    for _, i, v in sorted(rows, key=lambda r: key[r[1]]):
        want[i] = total
        total += v
    assert {r.idx: r.before for r in got} == want


@pytest.mark.parametrize("n", [1, 2, 3, 5, 97, 1000, 4097, 10007])
def test_permutation_and_back(n):
    x = np.arange(n)
    orders = [shuffle.permuted(x, n, seed, np.full(n, epoch)) for seed, epoch in ((1, 0), (1, 1), (2, 0))]
    for (seed, epoch), there in zip(((1, 0), (1, 1), (2, 0)), orders, strict=True):
        assert sorted(there.tolist()) == x.tolist() and (shuffle.permuted(there, n, seed, np.full(n, epoch), back=True) == x).all()
    if n > 90:
        for a, b in ((0, 1), (0, 2), (1, 2)):
            assert (orders[a] == orders[b]).mean() < 0.1
        assert all((o == x).mean() < 0.1 and abs(np.corrcoef(o, x)[0, 1]) < 0.35 for o in orders)
    a, b = shuffle.sides(n)
    assert a * b >= n and a * b - n < a


def test_large_numbers_stay_in_range():
    n = (1 << 59) + 12345
    x = np.random.default_rng(0).integers(0, n, 1000)
    there = shuffle.permuted(x, n, 7, np.zeros(1000))
    assert ((there >= 0) & (there < n)).all() and (shuffle.permuted(there, n, 7, np.zeros(1000), back=True) == x).all()


def test_order_without_a_shuffle(spark):
    rows = spark.range(50).withColumnRenamed("id", "idx")
    each = shuffle.in_epochs(rows, 50, 3)
    rest = shuffle.rows_from(spark, 50, 3, 1, 20)
    for df in (each, rest):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    whole = {(r.epoch, r.pos): r.idx for r in each.collect()}
    assert len(whole) == 150 and {(r.epoch, r.pos): r.idx for r in rest.collect()} == {k: v for k, v in whole.items() if k >= (1, 20)}
    assert shuffle.rows_from(spark, 50, 3, 3, 0).count() == 0 and shuffle.rows_from(spark, 0, 3, 0, 0).count() == 0
    out = rows.select(shuffle.place_of(F.col("idx") - 10, 5, 1, F.lit(0)).alias("p")).collect()
    assert [r.p is None for r in out] == [not 10 <= i < 15 for i in range(50)]


@pytest.mark.parametrize("kind", ["ends", "none", "empty", "long"])
@pytest.mark.parametrize("options", [{}, {"bos": 3}, {"keep_singletons": True, "flush_tail": True}, {"most": 2}])
def test_leftovers_are_what_the_fold_leaves(kind, options):
    """For every opening, as many tokens are left as the fold of the opening and the documents leaves."""
    rng = np.random.default_rng(len(kind) + len(options))
    size = {"ends": (1, 40), "none": (1, 40), "empty": (0, 3), "long": (200, 300)}[kind]
    eos = 0 if kind != "none" else 99
    docs = [([int(x) for x in rng.integers(1, 30, rng.integers(*size))] + ([0] if kind == "ends" else []), None) for _ in range(30)]
    docs = [(t, [x % 3 == 0 for x in t]) for t, _ in docs]
    ahead = [int(x) for x in rng.integers(1, 30, 15)]
    ahead = (ahead, [x % 3 == 0 for x in ahead])
    rest = {k: v for k, v in options.items() if k != "flush_tail"}
    got = corpus.leftovers(docs, ahead, 16, eos, {7, 9}, frozenset([11]), **rest)
    for n in range(16 - ("bos" in options)):
        opening = (ahead[0][15 - n :], ahead[1][15 - n :])
        fold = corpus.pack_stream([opening, *docs], 16, eos, {7, 9}, frozenset([11]), **rest)
        while True:
            try:
                next(fold)
            except StopIteration as end:
                assert got[n] == end.value
                break


@pytest.mark.parametrize("kind", ["ends", "none", "sparse"])
def test_streams_pack_as_one_fold(spark, kind):
    """Whatever the texts are like, cutting a domain into streams changes no chunk, and takes as many jobs."""
    rng = np.random.default_rng(5)
    docs = []
    for i in range(260):
        n = int(rng.integers(0, 3)) if kind == "sparse" else int(rng.integers(0, 30))
        t = [int(x) for x in rng.integers(12, 40, n)] + ([0] if kind == "ends" and i % 3 else [])
        docs.append((i, f"d{i % 2}" if i % 9 else None, t, [x % 3 == 0 for x in t]))
    frame = spark.createDataFrame(docs, "doc_id long, domain string, tokens array<int>, spaced array<boolean>")
    want = {}
    for d in ("d0", "d1", None):
        rows = [(t, s) for _, x, t, s in docs if x == d]
        want[d] = [c for c in corpus.pack_stream(rows, 16, 0, {13, 15}, frozenset([17]), flush_tail=True)]
    got = corpus.pack_sentences(frame, 16, 0, [13, 15], [17], docs_per_stream=5, flush_tail=True).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.stream, r.seq)):
        by.setdefault(r.domain, []).append((r.tokens, r.padding))
    assert by == want
