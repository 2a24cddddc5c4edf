"""Runs of repeated word sequences, by heavy/light lag counting.

For a lag q the words that equal the one q further on come in islands; an island of m words is a stretch of m + q words
with period q. How many words match at each lag is counted exactly: for a word that occurs often by the autocorrelation of
its places (a Fourier transform), for others from the differences of all pairs of places. A lag is searched for islands only
if its count, less what runs of a smaller period that divides it explain, is enough for one run.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import kernels as K

_PAIRS = 1 << 22  # pairs of places that are made at a time


def heavy_from(n: int) -> int:
    """The least number of occurrences for which a transform over n words is cheaper than all pairs."""
    return max(64, math.isqrt(8 * n * max(1, n.bit_length())))


def lag_counts(words: np.ndarray, heavy: int | None = None) -> np.ndarray:
    """How many words equal the one q further on, for each q up to half the length. words are numbers; those with `heavy`
    occurrences or more are counted by a transform."""
    n = len(words)
    half = n // 2
    out = np.zeros(half + 1, np.int64)
    order = np.argsort(words, kind="stable").astype(np.int64)
    first = np.flatnonzero(np.diff(words[order], prepend=-1))
    counts = np.diff(np.append(first, n))
    heavy = heavy_from(n) if heavy is None else heavy
    size = 1 << (n + half).bit_length()
    for a, c in zip(first[counts >= heavy], counts[counts >= heavy], strict=True):
        here = np.zeros(size)
        here[order[a : a + c]] = 1
        spectrum = np.fft.rfft(here)
        out += np.rint(np.fft.irfft(spectrum * spectrum.conj(), size)[: half + 1]).astype(np.int64)
    # the light ones: place j of a word's list against the one `step` further on, for all words at a time
    light = np.repeat(counts < heavy, counts)
    places, left = order[light], np.repeat((np.cumsum(counts) - 1), counts)[light] - np.flatnonzero(light)
    step, live = 1, np.flatnonzero(left >= 1)
    while len(live):
        for a in range(0, len(live), _PAIRS):
            lags = places[live[a : a + _PAIRS] + step] - places[live[a : a + _PAIRS]]
            out += np.bincount(lags[lags <= half], minlength=half + 1)
        step += 1
        live = live[left[live] >= step]
    out[0] = 0
    return out


def _islands(words: np.ndarray, q: int, least: int) -> list[tuple[int, int]]:
    """First place and end of the maximal stretches of at least `least` words that equal the one q further on. Each has a
    place that `least` divides, so only these are tried; what is around a match is looked at in growing steps."""
    n = len(words) - q
    tried = np.arange(0, n, least)
    out, done = [], 0
    for p in tried[words[tried] == words[tried + q]].tolist():
        if p < done:
            continue
        a = max(done, p - least + 1)
        miss = np.flatnonzero(words[a:p] != words[a + q : p + q])
        begin = a + int(miss[-1]) + 1 if len(miss) else a
        end, step = p + 1, least
        while end < n:
            b = min(n, end + step)
            miss = np.flatnonzero(words[end:b] != words[end + q : b + q])
            if len(miss):
                end += int(miss[0])
                break
            end, step = b, 2 * step
        done = end
        if end - begin >= least:
            out.append((begin, end))
    return out


def _primitive(root: np.ndarray) -> bool:
    """Whether no shorter sequence repeated gives root."""
    q = left = len(root)
    r = 2
    while left > 1:
        if r * r > left:
            r = left
        if left % r:
            r += 1
            continue
        while left % r == 0:
            left //= r
        p = q // r
        if (root[p:] == root[:-p]).all():
            return False
    return True


def runs_of(words: np.ndarray, least: int = 12, counts: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """start, length, period of the runs of a sequence of numbers, by start, then period: maximal stretches whose smallest
    period is at most half their length, of `least` words or more."""
    n = len(words)
    if n < least:
        return []
    counts = lag_counts(words) if counts is None else counts
    lags = np.arange(len(counts))
    enough = np.maximum(np.maximum(least - lags, lags), 1)
    explained = np.zeros(len(counts), np.int64)
    out = []
    for q in np.flatnonzero(counts[1:] >= enough[1:]) + 1:
        q = int(q)
        if counts[q] - explained[q] < enough[q]:
            continue
        found = [(a, b - a + q) for a, b in _islands(words, q, int(enough[q])) if _primitive(words[a : a + q])]
        if found:
            out += [(a, length, q) for a, length in found]
            # matches at the multiples of q that lie in these runs; no run of such a smallest period has them
            part = np.zeros(len(counts), np.int64)
            for _, length in found:
                multiples = np.arange(q, min(length, len(counts)), q)
                part[multiples] += length - multiples
            explained = np.maximum(explained, part)
    return sorted(out, key=lambda r: (r[0], r[2]))


def _edited(n: int, g: int) -> np.ndarray:
    """Which original word stands at each place of a document that is continued periodically."""
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def _order_of(i: int, ids: list, n: int, edit: bool) -> np.ndarray | None:
    """The edit of a document whose id's checksum ends in 0, else None."""
    import zlib

    if not edit or ids[i] is None or not n:
        return None
    h = zlib.crc32(str(ids[i]).encode())
    return _edited(n, h // 10) if h % 10 == 0 else None


_SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def find(docs: DataFrame, edit: bool = False, texts: bool = True, least: int = 12) -> DataFrame:
    """doc_id, n_runs, the run of greatest length (ties: least start, then period) as start, length, period (words, from 0)
    and exponent_milli (nulls without a run), runs_sha256 of all runs' `start,length,period` lines, collapsed_sha256, runs
    and collapsed of each row of docs (doc_id, text). collapsed has the words one blank apart, without those that a run
    contains after its first period; texts=False leaves runs and collapsed null.

    edit: documents whose id's crc32 ends in 0 (decimal) are continued periodically from a place on that it sets, as a test
    of the search; a row without an id has no edit. Null, empty and blank texts have no runs and an empty collapsed
    text. Words are compared byte by byte, in their case. A row is looked at alone, so repeated rows give equal results; a
    very long text takes memory in proportion to its words. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in K.slices(batch.column(1)):
                yield _found(batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), edit, texts, least)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCHEMA)


def _found(ids: pa.Array, column: pa.Array, edit: bool, texts: bool, least: int) -> pa.RecordBatch:
    data, at = K.utf8(column)
    starts, lengths, rows = K.runs(data, at)
    code, _ = K.codes(data, starts, lengths)
    edges = np.searchsorted(rows, np.arange(len(column) + 1))
    names = ids.to_pylist()
    listed, best, digests, kept = [], [], [], []
    for i in range(len(column)):
        a, b = int(edges[i]), int(edges[i + 1])
        order = _order_of(i, names, b - a, edit)
        place = np.arange(a, b) if order is None else a + order
        found = runs_of(code[place], least)
        listed.append(found)
        top = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else (None, None, None)
        best.append((*top, 1000 * top[1] // top[2] if found else None))
        digests.append(hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest())
        if found:
            change = np.zeros(b - a + 1, np.int64)
            for s, n, q in found:
                change[s + q] += 1
                change[s + n] -= 1
            place = place[np.cumsum(change[:-1]) == 0]
        kept.append(place)
    counts = np.array([len(k) for k in kept], np.int64)
    where = np.concatenate(kept) if kept else np.zeros(0, np.int64)
    # each kept word and a blank; the last one's is left out
    wide = lengths[where] + 1
    picked, ends = K.pick(np.append(data, np.uint8(0x20)), starts[where], wide)
    if len(where):
        picked[ends[1:] - 1] = 0x20
    joined = picked.tobytes()
    first = np.concatenate([[0], np.cumsum(counts)])
    collapsed = [joined[ends[first[i]] : ends[first[i + 1]] - 1] if counts[i] else b"" for i in range(len(column))]
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    cells = [
        ids, pa.array([len(x) for x in listed], pa.int64()), *(pa.array([x[k] for x in best], pa.int64()) for k in range(4)), pa.array(digests, pa.string()),
        pa.array([hashlib.sha256(x).hexdigest() for x in collapsed], pa.string()), pa.array([[{"start": s, "length": n, "period": q} for s, n, q in x] if texts else None for x in listed], run_type),
        pa.array([x.decode() if texts else None for x in collapsed], pa.string()),
    ]
    return pa.RecordBatch.from_arrays(cells, ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed"])
