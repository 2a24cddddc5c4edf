"""Best-fit packing by a linear grouping scheme.

Documents are cut into pieces of at most `capacity` ids. Large pieces are sorted by length into groups of equal
cardinality and rounded up to the longest of the group; the few sizes that remain make a cutting-stock problem,
which column generation solves over configurations (multisets of sizes that fit a sequence). Whole parts of the
solution are used; each slot then gets an actual piece of its group, and what is left, like the small pieces, goes by
best fit, longest first, where the least room is left over.

All of that needs only how many pieces have each length, at most `capacity` numbers, so the plan is made on the driver
from a histogram and its size does not grow with the input. A piece finds its place from its rank among the pieces of
its length, which is counted by prefix sums over hash buckets.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import encoding
from millrace.llm import kernels as K
from millrace.llm.store import cut

Run = tuple[int, list[int]]  # so many sequences, each with pieces of these lengths in this order


def _best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the configuration of the highest worth."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    least = int(sizes.min())
    for c in range(least, capacity + 1):
        room = c - sizes
        value = np.where(room >= 0, best[np.maximum(room, 0)] + worth, -1.0)
        i = int(value.argmax())
        if value[i] > best[c - 1]:
            best[c], pick[c] = value[i], i
        else:
            best[c] = best[c - 1]
    config, c = np.zeros(len(sizes)), capacity
    while c >= least:
        if pick[c] < 0:
            c -= 1
        else:
            config[pick[c]] += 1
            c -= int(sizes[pick[c]])
    return float(best[capacity]), config


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 600) -> list[tuple[int, list[int]]]:
    """Column generation with a revised simplex: (times, pieces of each size), times rounded down."""
    s, d = np.array(sizes), np.array(demand, float)
    columns = np.diag((capacity // s).astype(float))
    inverse = np.diag(1.0 / np.diag(columns))
    for _ in range(rounds):
        worth = inverse.sum(axis=0)
        value, new = _best_configuration(s, np.maximum(worth, 0), capacity)
        if value <= 1 + 1e-5:
            break
        step, have = inverse @ new, inverse @ d
        ratio = np.where(step > 1e-9, have / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        columns[:, out] = new
        inverse = np.linalg.inv(columns)
    times = inverse @ d
    return [(int(x + 1e-6), columns[:, i].astype(int).tolist()) for i, x in enumerate(times) if x >= 1 - 1e-6]


def plan(histogram: dict[int, int], capacity: int, groups: int = 48, small: float = 0.125) -> list[Run]:
    """Sequences for so many pieces of each length, as runs of equal ones."""
    runs: list[Run] = []
    left = {k: n for k, n in histogram.items() if n and k < capacity}
    if histogram.get(capacity):
        runs.append((histogram[capacity], [capacity]))
    large = sorted((k for k in left if k > small * capacity), reverse=True)
    total = sum(left[k] for k in large)
    groups = min(groups, len(large))
    queues: list[list[list[int]]] = []  # per group: [length, pieces], longest first
    if groups:
        per, room = -(-total // groups), 0
        for k in large:
            n = left[k]
            while n:
                if not room:
                    queues.append([])
                    room = per
                m = min(n, room)
                queues[-1].append([k, m])
                n, room = n - m, room - m
        merged: list[list[list[int]]] = []
        for q in queues:  # groups of one length are one size
            if merged and merged[-1][0][0] == q[0][0]:
                merged[-1] += q
            else:
                merged.append(q)
        queues = merged
        for times, config in configurations([q[0][0] for q in queues], [sum(n for _, n in q) for q in queues], capacity):
            slots = [g for g, n in enumerate(config) for _ in range(n)]
            times = min([times, *(sum(n for _, n in queues[g]) // config[g] for g in set(slots))])
            taken = []
            for g in slots:  # the next `times` actual pieces of the group
                got, need = [], times
                while need:
                    k, n = queues[g][0]
                    m = min(n, need)
                    got.append((k, m))
                    need -= m
                    left[k] -= m
                    if m == n:
                        queues[g].pop(0)
                    else:
                        queues[g][0][1] -= m
                taken.append(got)
            edges = sorted({0, times, *(int(e) for got in taken for e in np.cumsum([m for _, m in got]))})
            ends = [np.cumsum([m for _, m in got]) for got in taken]
            for a, b in zip(edges, edges[1:], strict=False):
                runs.append((b - a, [got[int(np.searchsorted(end, a, "right"))][0] for got, end in zip(taken, ends, strict=True)]))

    by_room: dict[int, list[Run]] = {}
    rooms: list[int] = []

    def put(n: int, lengths: list[int]) -> None:
        room = capacity - sum(lengths)
        if room not in by_room:
            by_room[room] = []
            bisect.insort(rooms, room)
        by_room[room].append((n, lengths))

    for n, lengths in runs:
        put(n, lengths)
    for k in sorted(left, reverse=True):
        n = left[k]
        while n:
            at = bisect.bisect_left(rooms, k)
            if at == len(rooms):
                each = capacity // k
                if n >= each:
                    put(n // each, [k] * each)
                if n % each:
                    put(1, [k] * (n % each))
                break
            room = rooms[at]
            m, lengths = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
            if m > n:
                put(m - n, lengths)
                m = n
            put(m, [*lengths, k])
            n -= m
    return [run for room in rooms for run in by_room[room]]


def pieces(docs: DataFrame, tokenizer: str, end: int = 0, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of docs (doc_id, text); null text has the end id alone."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding.encoder(tokenizer, False)
        for batch in batches:
            for i, j in K.slices(batch.column(1)):
                ids, at = enc.encode(batch.column(1).slice(i, j - i), end)
                ids = ids.astype("<u4")
                n = -(-np.diff(at) // capacity)
                row = np.repeat(np.arange(j - i), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(at[row + 1] - at[row] - start, capacity)
                from_ = at[row] + start
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(from_.tolist(), (from_ + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut_up, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, end: int = 0, capacity: int = 2048, groups: int = 48, per_bucket: int = 5_000) -> DataFrame:
    """Pieces with sequence_id and offset. Sequences are numbered from 0; a sequence has no gaps.

    Null and empty texts are pieces of length 1 (the end id); repeated rows and doc_ids are packed each by itself;
    pieces of equal length are interchangeable and placed in order of a hash of doc_id, then doc_id, piece and crc.
    An empty table gives an empty table.
    """
    table = cut(pieces(docs, tokenizer, end, capacity))
    counts = table.groupBy("length").count().collect()  # at most `capacity` rows
    runs = plan({int(r[0]): int(r[1]) for r in counts}, capacity, groups)
    used: dict[int, int] = {}
    rows, seq = [], 0
    for n, lengths in runs:
        offset = 0
        for k in lengths:
            rows.append((k, used.get(k, 0), seq, offset))
            used[k] = used.get(k, 0) + n
            offset += k
        seq += n
    rows.sort()
    length, rank, first, offset = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 4
    key = length << 44 | rank

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = batch.column(3).to_numpy() << 44 | batch.column(5).to_numpy()
            at = np.searchsorted(key, want, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(first[at] + want - key[at]), pa.array(offset[at])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    buckets = max(1, -(-sum(int(r[1]) for r in counts) // per_bucket))
    spread = table.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = spread.groupBy("length", "_b").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    ranked = spread.withColumn("_in", F.row_number().over(Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "ids_crc32")) - 1).join(base, ["length", "_b"])
    kind = table.schema["doc_id"].dataType.simpleString()
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_base") + F.col("_in")).cast("long").alias("_rank")).mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
