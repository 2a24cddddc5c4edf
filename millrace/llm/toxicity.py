"""Toxicity from two class-conditional Kneser-Ney models.

A toxic and an ordinary model give the characters (bytes) of each word, with the word's start as context, a likelihood.
The highest order is the class's own; what it discounts goes to lower orders that count continuations in both classes
together, so an expression that is rare or unknown in both costs both models the same. A text's score compares the two
log-likelihoods per word, with the share of words that speak clearly for toxic, through a logistic curve fitted on the
learning rows.

Learning uses at most `most_rows` labelled rows (by a seeded hash), so what is broadcast has a size that does not grow
with the corpus. Grams are counted on the executors; the driver gets one row for each distinct gram of the highest
order, as numbers, and never words or texts. Scoring covers every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import kernels as K
from millrace.llm.store import Table, hold, release

ORDER = 6
CLEAR = (2.0, 3.5, 5.0)  # natural-log ratios from which a word speaks more and more clearly
_KNOWN = 1_000_000  # words whose ratio a worker remembers


def _padded(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of each word with ORDER - 1 zeros before and one 1 after, places of its symbols (end included), and their word."""
    total = lengths + ORDER
    at = np.cumsum(total) - total
    out = np.zeros(int(total.sum()), np.uint8)
    within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(at + ORDER - 1, lengths) + within] = K.LOWER[data[np.repeat(starts, lengths) + within]]
    out[at + ORDER - 1 + lengths] = 1
    n = lengths + 1
    places = np.repeat(at + ORDER - 1, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return out, places, np.repeat(np.arange(len(starts)), n)


def _grams(symbols: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """The n bytes that end at each place, as one number (n is 7 at most)."""
    out = np.zeros(len(places), np.uint64)
    for j in range(n - 1, -1, -1):
        out = (out << np.uint64(8)) | symbols[places - j].astype(np.uint64)
    return out | np.uint64(n) << np.uint64(56)


def _look(keys: np.ndarray, values: np.ndarray, want: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(want))
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return np.where(keys[at] == want, values[at], 0.0)


def _sum_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(keys, return_inverse=True)
    return keys, np.bincount(back, weights=values, minlength=len(keys))


def _context(grams: np.ndarray, n: int) -> np.ndarray:
    return (grams & np.uint64((1 << 56) - 1)) >> np.uint64(8) | np.uint64(n - 1) << np.uint64(56)


class Level:
    """Discounted relative frequencies of one order: gram -> max(c - D, 0) / c(context), context -> what is left."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, n: int):
        self.n = n
        once, twice = (counts == 1).sum(), (counts == 2).sum()
        d = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5
        d = d * np.minimum(counts, 1)
        contexts, back = np.unique(_context(grams, n), return_inverse=True)
        total = np.bincount(back, weights=counts)
        self.grams, self.p = grams, (counts - d) / total[back]
        self.contexts, self.left = contexts, np.bincount(back, weights=d) / total

    def apply(self, symbols: np.ndarray, places: np.ndarray, lower: np.ndarray) -> np.ndarray:
        gram = _grams(symbols, places, self.n)
        context = _context(gram, self.n)
        at = np.minimum(np.searchsorted(self.contexts, context), max(0, len(self.contexts) - 1))
        known = self.contexts[at] == context if len(self.contexts) else np.zeros(len(gram), bool)
        return np.where(known, _look(self.grams, self.p, gram) + (self.left[at] if len(self.contexts) else 0) * lower, lower)


class Model:
    """Both classes' models and the curve that turns a text's comparison into a score."""

    def __init__(self, top: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray):
        """top: ascending distinct grams of the highest order; how often each comes in toxic and in ordinary rows."""
        self.own = [Level(top[times > 0], times[times > 0].astype(float), ORDER) for times in (toxic, ordinary)]
        self.shared: list[Level] = []
        distinct = top
        for n in range(ORDER - 1, 0, -1):  # continuation counts: in how many longer grams a gram ends
            mask = np.uint64((1 << (8 * n)) - 1)
            keys, counts = _sum_by((distinct & mask) | np.uint64(n) << np.uint64(56), np.ones(len(distinct)))
            self.shared.append(Level(keys, counts, n))
            distinct = keys
        self.curve = np.array([-30.0] + [0.0] * (1 + len(CLEAR)))  # until calibrated, nothing is toxic
        self.known, self.ratio = np.zeros(0, np.uint64), np.zeros(0)

    def ratios(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Natural log of toxic over ordinary likelihood of each word."""
        symbols, places, of = _padded(data, starts, lengths)
        p = np.full(len(places), 1 / 256)
        for level in reversed(self.shared):
            p = level.apply(symbols, places, p)
        toxic, ordinary = (own.apply(symbols, places, p) for own in self.own)
        return np.bincount(of, weights=np.log(toxic) - np.log(ordinary), minlength=len(starts))

    def features(self, column: pa.Array) -> np.ndarray:
        """Of each row: one, the mean ratio per word, and by how much words pass each of CLEAR, per word."""
        data, at = K.utf8(column)
        starts, lengths, rows = K.runs(data, at)
        keys, first, back = np.unique(K.hash_runs(data, starts, lengths), return_index=True, return_inverse=True)
        if len(self.known) > _KNOWN:
            self.known, self.ratio = np.zeros(0, np.uint64), np.zeros(0)
        to = np.searchsorted(self.known, keys)
        new = self.known[np.minimum(to, len(self.known) - 1)] != keys if len(self.known) else np.ones(len(keys), bool)
        if new.any():
            to = to[new]
            self.ratio = np.insert(self.ratio, to, self.ratios(data, starts[first[new]], lengths[first[new]]))
            self.known = np.insert(self.known, to, keys[new])
        ratio = self.ratio[np.searchsorted(self.known, keys)][back] if len(keys) else np.zeros(0)
        n = len(at) - 1
        words = np.maximum(np.bincount(rows, minlength=n), 1)
        sums = [np.bincount(rows, weights=x, minlength=n) / words for x in (ratio, *(np.maximum(ratio - c, 0) for c in CLEAR))]
        return np.stack([np.ones(n), sums[0], *(np.sqrt(x) for x in sums[1:])], axis=1)

    def calibrate(self, x: np.ndarray, toxic: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> None:
        """Logistic regression of the label on features, with a small ridge."""
        w = np.zeros(x.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
            step = np.linalg.solve(h, x.T @ (toxic - p) - ridge * w)
            w += step * min(1.0, 5 / (np.abs(step).max() + 1e-9))
            if np.abs(step).max() < 1e-6:
                break
        self.curve = w

    def score(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(column) @ self.curve, -30, 30)))


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams of the highest order in rows (toxic 0/1, text), with how often each comes in toxic and in ordinary rows."""
    sums = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
    for batch in batches:
        for i, j in K.slices(batch.column(1), 2 << 20):
            data, at = K.utf8(batch.column(1).slice(i, j - i))
            starts, lengths, rows = K.runs(data, at)
            if not len(starts):
                continue
            toxic = batch.column(0).to_numpy()[i:j][rows] > 0
            _, first, back = np.unique(K.hash_runs(data, starts, lengths), return_index=True, return_inverse=True)
            symbols, places, of = _padded(data, starts[first], lengths[first])
            times = [np.bincount(back, weights=x)[of] for x in (toxic, ~toxic)]
            keys, place = np.unique(np.concatenate([sums[0], _grams(symbols, places, ORDER)]), return_inverse=True)
            sums = keys, *(np.bincount(place, weights=np.concatenate([a, b])) for a, b in zip(sums[1:], times, strict=True))
    yield pa.RecordBatch.from_arrays([pa.array(sums[0].view(np.int64)), *(pa.array(x.astype(np.int64)) for x in sums[1:])], ["gram", "t", "o"])


def learn(docs: DataFrame, labels: DataFrame, most_rows: int = 12_000, seed: int = 42) -> Model:
    """A calibrated model from docs (doc_id, text) and labels (doc_id, toxic 0/1).

    At most `most_rows` labelled rows, the first by a seeded hash of doc_id, then of their text, are used: two thirds for
    counts, one third for the curve. Rows with null doc_id or label are ignored, rows of one doc_id and text count once; a
    doc_id with several labels is toxic if one says so. Without labelled rows of both classes everything scores near 0.
    """
    picked = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = picked.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(most_rows).withColumn("_curve", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(3)) == 0)
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    held = Table(docs.select("doc_id", "text").join(picked, "doc_id").withColumn("_t", text_hash).dropDuplicates(["doc_id", "_t"]))
    # ids that many rows share bring no more rows than the bound: the last one's place is found without any text
    place = F.struct(F.xxhash64(F.lit(seed), "doc_id").alias("a"), F.col("doc_id").alias("b"), F.col("_t").alias("c"))
    places = held.rows.select(place.alias("_p"))
    last = places.orderBy("_p").limit(most_rows).agg(F.max("_p")).first()[0]
    rows = held.rows if last is None else held.rows.filter(place <= F.struct(*(F.lit(v).alias(n) for v, n in zip(last, "abc", strict=True))).cast(places.schema["_p"].dataType))
    grams = rows.filter("not _curve").select("toxic", "text").mapInArrow(counted, "gram long, t long, o long")
    grams = grams.groupBy("gram").agg(F.sum("t").alias("t"), F.sum("o").alias("o")).orderBy("gram").toArrow()  # ORDER bytes are below the sign
    model = Model(*(grams.column(c).to_numpy().astype(kind) for c, kind in zip(("gram", "t", "o"), (np.uint64, np.int64, np.int64), strict=True)))
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in K.slices(batch.column(1), 2 << 20):
                x = shipped.value.features(batch.column(1).slice(i, j - i))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(x.tolist(), pa.list_(pa.float64()))], ["toxic", "x"])

    got = rows.filter("_curve").select("toxic", "text").mapInArrow(features, "toxic int, x array<double>").toArrow()
    held.remove()
    y = np.array(got["toxic"].to_pylist(), float)
    if 0 < y.sum() < len(y):
        model.calibrate(np.array(got["x"].to_pylist()), y)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score: 0 to 1, higher for toxic. Null and empty texts score as a text without words does."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    held = hold(docs, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in K.slices(batch.column(0), 2 << 20):
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shipped.value.score(part.column(0)))], [*batch.schema.names, "score"])

    return release(held.mapInArrow(run, held.withColumn("score", F.lit(0.0)).schema), docs.columns, "score")
