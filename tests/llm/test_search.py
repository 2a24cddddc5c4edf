"""Top-k inner products and ranked retrieval against plain versions."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import topk, wavelet
from tests.llm.conftest import clashing

NAN, INF = float("nan"), float("inf")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def usable(e):
    return e is not None and all(x is not None and math.isfinite(x) for x in e)


def plain_top(vectors, queries, k):
    """Rows (query_id, rank, vec_id, score); an id's last key is whether it is null."""
    order = lambda i: (i is None, i or 0)
    out = []
    for q, e in {(q, tuple(e)) for q, e in queries if usable(e)}:
        x = [math.floor(256 * v) for v in e]
        found = [(sum(a * math.floor(256 * b) for a, b in zip(x, f, strict=True)), c) for c, f in vectors if usable(f) and len(f) == len(x) and (q is None or c != q)]
        for rank, (score, c) in enumerate(sorted(found, key=lambda r: (-r[0], order(r[1])))[:k], 1):
            out.append((q, rank, c, score))
    return sorted(out, key=str)


def top(spark, vectors, queries, k=5, kind="double", **options):
    frames = [spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3) for rows in (vectors, queries)]
    return sorted((tuple(r) for r in topk.search(*frames, k=k, **options).select("query_id", "rank", "vec_id", "score").collect()), key=str)


def test_top_of_ties_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.integers(-3, 4, 4) / 8]) for i in range(120)]
    vectors += [(200 + i, [0.25, 0.25, 0.25, 0.25]) for i in range(60)]  # a large group of copies
    vectors += [(300, None), (301, []), (302, [NAN] * 4), (303, [1.0, None, 1.0, 1.0]), (304, [INF, 1.0, 1.0, 1.0]), (305, [1.0, 2.0]), (306, [1.0, 2.0]), (None, [0.25] * 4), (7, [0.25] * 4), (7, [0.25] * 4)]
    queries = [v for v in vectors if v[0] is None or v[0] % 7 == 0 or v[0] > 299]
    for bins, block in ((256, 4096), (4, 16)):
        assert top(spark, vectors, queries, bins=bins, block=block) == plain_top(vectors, queries, 5)
    assert top(spark, vectors, queries, k=1) == plain_top(vectors, queries, 1)
    assert top(spark, vectors[:3], vectors[:1], k=50) == plain_top(vectors[:3], vectors[:1], 50)


def test_top_of_many_rows_in_blocks(spark):
    """Wide enough blocks that a cell leaves out what cannot be among the best."""
    rng = np.random.default_rng(5)
    vectors = [(i, [float(x) for x in rng.normal(size=3).round(2)]) for i in range(1500)]
    queries = vectors[::150]
    assert top(spark, vectors, queries, block=600, tile=3) == plain_top(vectors, queries, 5)


@pytest.mark.parametrize("size", [1e3, 1e6, 1e9])
def test_top_is_exact_for_large_components(spark, size):
    """Sums that need 64-bit floats, and those that need whole numbers of any size."""
    rng = np.random.default_rng(6)
    vectors = [(i, [float(x) for x in rng.normal(size=3) * size]) for i in range(40)]
    want = [(q, r, c, max(-topk._BOUND, min(topk._BOUND, s))) for q, r, c, s in plain_top(vectors, vectors[:4], 5)]
    got = top(spark, vectors, vectors[:4])
    assert [r[3] for r in got] == [r[3] for r in want]
    if size < 1e9:
        assert got == want


def test_top_of_empty_tables_and_extra_columns(spark):
    assert top(spark, [], []) == [] and top(spark, [(1, [1.0])], [(1, [1.0])]) == []
    docs = clashing(spark.createDataFrame([(1, [1.0]), (50, [2.0])], "vec_id long, embedding array<float>")).withColumnsRenamed({"size": "qb", "part": "ids", "h": "low"})
    assert [tuple(r) for r in topk.search(docs, docs.filter("vec_id = 50")).collect()] == [(50, 1, 1, 256 * 512)]


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain_ranks(docs, items, k):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    n, total = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        asked = Counter(terms(text))
        found = []
        for d, b in bags:
            m = 100 - 25 + (25 * sum(b.values()) * n) // total if total else 0
            score = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 12 * m)) for t, c in asked.items() if t in b)
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, rank, None if null else d, -s) for rank, (s, null, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def ranks(docs, items, k=20, shard_bytes=4 << 20, **options):
    shards = wavelet.index(docs, shard_bytes=shard_bytes)
    out = sorted((tuple(r) for r in wavelet.search(shards, items, k, **options).select("item_id", "rank", "doc_id", "score").collect()), key=str)
    shards.table.remove()
    return out


@pytest.mark.parametrize(("table", "shard_bytes"), [("small", 4 << 20), ("small", 20_000), ("odd", 1 << 20), ("odd", 1)])
def test_ranks(spark, sf_dir, table, shard_bytes, request):
    docs = request.getfixturevalue(table)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    asked = [(r.item_id, r.text) for r in items.collect()]
    asked += [(900, "the THE the one naïve 東京"), (901, None), (902, ""), (902, "two"), (None, "straße Straße"), (903, "-- ..."), (904, " ".join(t for _, t in rows if t)[:3000])]
    got = ranks(docs, spark.createDataFrame(asked, "item_id long, text string"), shard_bytes=shard_bytes)
    assert got == plain_ranks(rows, asked, 20)


def test_ranks_of_ties_and_copies(spark):
    rows = [(i, "same words here") for i in range(300, 0, -1)] + [(400 + i, f"same words here and w{i % 7}") for i in range(50)] + [(5, "here"), (5, "here"), (None, "here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    items = [(1, "same words"), (2, "w3 same"), (3, "here here"), (1, "w1")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    for k in (1, 20, 400):
        assert ranks(docs, frame, k, shard_bytes=700) == plain_ranks(rows, items, k)
    assert ranks(docs, frame, 20, most=5) == plain_ranks(rows, items, 20)  # each item in a pass of its own


def test_ranks_of_empty_tables_and_extra_columns(spark, empty, odd):
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert ranks(empty, items) == [] and ranks(odd, items.limit(0)) == []
    assert ranks(clashing(odd), clashing(items).withColumnsRenamed({"h": "q", "n": "rank"})) == plain_ranks([(r.doc_id, r.text) for r in odd.collect()], [(1, "one")], 20)


def test_nodes_are_opened_by_bound(monkeypatch):
    """Where one document has the greatest impacts, little else than the way to it is opened."""
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 40, 30)) for _ in range(512)]
    texts[300] = "rare " * 4 + texts[300] + " w1"
    row = wavelet.build(pa.array(range(512)), pa.array(texts), 512, 512 * 30)
    shard = wavelet.Shard({name: row.column(i)[0] for i, name in enumerate(row.schema.names)})
    lo, hi = shard.ranges(pa.array([b"rare", b"w1", b"nowhere"], pa.binary()))
    assert (hi - lo).tolist()[::2] == [1, 0]
    opened, sums = [], wavelet._sums
    monkeypatch.setattr(wavelet, "_sums", lambda values, sizes: opened.append(len(sizes)) or sums(values, sizes))
    item, doc, score = shard.best(np.zeros(3, np.int64), lo, hi, np.array([10_000, 1, 1]), 1, np.ones(1, np.int64), width=1)
    words = texts[300].split()
    worth = wavelet.impact(np.array([4, words.count("w1")]), np.array([len(words)] * 2), 512, 512 * 30)
    assert (item.tolist(), doc.tolist(), score.tolist()) == ([0], [300], [10_000 * worth[0] + worth[1]]) and sum(opened) < 200
