"""Held-out accuracy of the toxicity models, word ratios against a plain version, and odd rows."""

import collections
import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import queries, toxicity
from tests.llm.conftest import clashing


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    out = queries.op3_toxicity(spark, folder).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    rows = [(r.score, truth[r.doc_id], r.predicted) for r in out if r.held_out and r.doc_id in truth]
    good, bad = [s for s, t, _ in rows if t == 1], [s for s, t, _ in rows if t == 0]
    auc = sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.9
    assert sum(t == p for _, t, p in rows) / len(rows) > 0.9


def plain_ratio(word, grams):
    """Log ratio of one word's likelihoods, from counted grams (toxic, ordinary) and the definition of Kneser-Ney."""
    symbols = bytes(toxicity.ORDER - 1) + word.lower().encode() + b"\x01"

    def smoothed(counts, gram, lower):
        known = [c for g, c in counts.items() if g[:-1] == gram[:-1]]
        once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
        d = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5
        return (max(counts.get(gram, 0) - d, 0) + d * len(known) * lower) / sum(known) if known else lower

    lower_orders, longer = [], set(grams[0]) | set(grams[1])
    for _ in range(toxicity.ORDER - 1):
        ends = collections.Counter(g[1:] for g in longer)
        lower_orders.append(ends)
        longer = set(ends)
    out = 0.0
    for i in range(toxicity.ORDER - 1, len(symbols)):
        p = 1 / 256
        for counts in reversed(lower_orders):
            n = len(next(iter(counts)))
            p = smoothed(counts, symbols[i - n + 1 : i + 1], p)
        toxic, ordinary = (smoothed(c, symbols[i - toxicity.ORDER + 1 : i + 1], p) for c in grams)
        out += math.log(toxic) - math.log(ordinary)
    return out


def test_against_plain_kneser_ney(spark):
    texts = [(1, "vile vile scum of the Earth", 1), (2, "the earth is round and the sea is wide", 0), (3, "you vile thing, du böser Wicht", 1), (4, "a scullery of the thing that is", 0), (5, "the the the", 0)]
    grams = collections.Counter(), collections.Counter()
    for _, text, toxic in texts:
        for word in text.lower().split():
            symbols = bytes(toxicity.ORDER - 1) + word.encode() + b"\x01"
            grams[1 - toxic].update(symbols[i - toxicity.ORDER + 1 : i + 1] for i in range(toxicity.ORDER - 1, len(symbols)))
    rows = spark.createDataFrame([(t, x) for _, x, t in texts], "toxic int, text string").repartition(3)
    counted = rows.mapInArrow(toxicity.counted, "gram long, t long, o long").groupBy("gram").agg(F.sum("t"), F.sum("o")).orderBy("gram").collect()
    model = toxicity.Model(*(np.array(x, kind) for x, kind in zip(zip(*counted, strict=True), (np.uint64, np.int64, np.int64), strict=True)))
    asked = ["vile", "vil", "scum", "the", "THE", "thing", "unheard", "böser", "e", "東"]
    data = " ".join(asked).encode()
    ends = np.cumsum([len(w.encode()) + 1 for w in asked]) - 1
    lengths = np.array([len(w.encode()) for w in asked])
    got = model.ratios(np.frombuffer(data, np.uint8), ends - lengths, lengths)
    assert np.allclose(got, [plain_ratio(w, grams) for w in asked], atol=1e-9)
    assert got[0] > 1 > got[3]


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1), (5, 1), (8, 0), (12, 0), (15, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    model = toxicity.learn(odd, labels)
    docs = clashing(odd).drop("score")
    out = toxicity.score(docs, model)
    assert out.columns == [*docs.columns, "score"]
    rows = out.collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not (r.text or "").split()}) == 1
    assert toxicity.score(empty, model).count() == 0


def test_without_labels_nothing_is_toxic(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(odd, toxicity.learn(odd, none)).filter(F.col("score") >= 0.3).count() == 0


def test_an_id_of_many_rows_brings_no_more_than_the_bound(spark, monkeypatch):
    """The bound holds for joined rows, whatever shares an id."""
    texts = [(7, f"row {i} of one id and some words") for i in range(400)] + [(i, f"the text of document {i} is plain") for i in range(100, 160)] + [(7, "row 1 of one id and some words")] * 50
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1)] + [(i, i % 2) for i in range(100, 160)], "doc_id long, toxic int")
    seen, calibrate = [], toxicity.Model.calibrate
    monkeypatch.setattr(toxicity.Model, "calibrate", lambda self, x, y: seen.append(len(y)) or calibrate(self, x, y))
    for most in (30, 90, 10_000):
        toxicity.learn(docs, labels, most_rows=most)
    # a third of the ids, whole, are for the curve
    assert all(n <= most for n, most in zip(seen, (30, 90, 10_000), strict=False)) and len(seen) <= 3


def test_clashing_score(odd, small, spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = clashing(odd)
    out = toxicity.score(docs, toxicity.learn(small, labels))
    assert out.count() == odd.count() and sorted(out.columns) == sorted(docs.columns) and out.schema["score"].dataType.simpleString() == "double"
