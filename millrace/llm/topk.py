"""Exact top-k inner products by distributed histogram selection.

1. Components become integers; every task writes its vectors as blocks, queries are dealt into blocks of their own.
2. A cell is one block of queries against one block of candidates. Cells are an equality join on (query block, bucket):
   queries go to each bucket, candidates to each query block, so no side is copied whole to a machine.
3. A round scores all cells and counts, for each query, the scores of its open interval in `bins` equal bins. A cell
   counts from the top down to the bin of its own kth score, as the global one is not below that. Sums of all cells tell
   the bin that holds the kth value; it is the next round's interval. As scores are integers and widths powers of two, a
   known number of rounds leaves one value.
4. A last round keeps scores above that value, and of those equal to it the least ids that are still wanted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.store import Table

_BOUND = 2**62 - 1  # components and scores beyond count as this
_BLOCK = "qb int, dim int, n int, ids binary, matrix binary"


def integers(column: pa.Array, scale: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows and floor(scale * x) of the vectors of each length; those with a null or non-finite component are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(column)
    values = pc.fill_null(flat.cast(pa.float64()), math.nan).to_numpy(zero_copy_only=False)
    first = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    out = []
    for dim in np.unique(lengths[lengths >= 0]):
        rows = np.flatnonzero(lengths == dim)
        with np.errstate(all="ignore"):
            x = values[first[rows][:, None] + np.arange(dim)]
            good = np.isfinite(x).all(axis=1)
            whole = np.clip(np.floor(scale * x[good]), -_BOUND, _BOUND)
        out.append((rows[good], whole))
    return out


def _blocks(column: pa.Array, scale: float, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """dim, rows and integers of at most `most` vectors of one length at a time."""
    for rows, whole in integers(column, scale):
        for i in range(0, len(rows), most):
            yield whole.shape[1], rows[i : i + most], whole[i : i + most]


def _number(ids: pa.Array) -> np.ndarray:
    """Ids as longs with a second column that is 1 for null, which is no id's own and comes after all."""
    null = pc.is_null(ids).to_numpy(zero_copy_only=False)
    value = pc.fill_null(ids.cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(np.stack([value, null.astype(np.int64)], axis=1))


def _pack(vectors: DataFrame, scale: float, most: int, numbered: bool) -> DataFrame:
    """Blocks of the vectors (vec_id, embedding) of each task; numbered: the task's number is that of its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for batch in batches:
            for dim, rows, whole in _blocks(batch.column(1), scale, most):
                ids = _number(batch.column(0).take(pa.array(rows)))
                narrow = np.abs(whole).max(initial=0) <= 2**24
                cells = [[task if numbered else -1], [dim], [len(rows)], [ids.tobytes()], [whole.astype(np.float32 if narrow else np.float64).tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, _TYPES, strict=True)], _NAMES)

    return vectors.select("vec_id", "embedding").mapInArrow(run, _BLOCK)


_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
_NAMES = ["qb", "dim", "n", "ids", "matrix"]


def _matrix(b: pa.BinaryScalar, n: int, dim: int) -> np.ndarray:
    """A block's integers, which are written in four bytes each where they fit."""
    data = b.as_buffer()
    return np.frombuffer(data, np.float32 if data.size == 4 * n * dim else np.float64).reshape(n, dim)


def _kind(bound: float) -> type:
    """The narrowest type in which sums of integers up to `bound` are exact."""
    return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else object


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of rows of integers in the type that _kind() gave for them."""
    if q.dtype != object:
        return q @ c.T
    return np.array([[max(-_BOUND, min(_BOUND, sum(x * y))) for y in c] for x in q], np.int64).reshape(len(q), len(c))


def _integers_as(matrix: np.ndarray, kind: type) -> np.ndarray:
    if kind is not object:
        return matrix.astype(kind)
    return np.array([int(v) for v in matrix.ravel()] or [0], object)[: matrix.size].reshape(matrix.shape)


def _cells(batch: pa.RecordBatch, bound: float, tile: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, dict[str, np.ndarray]]]:
    """Query block, first query, scores, candidates' ids and the queries' state, for `tile` queries at a time of the
    cells in batch. The score of a query's own row is below all others."""
    kind = _kind(bound)
    for i in range(batch.num_rows):
        row = {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}
        dim = row["dim"].as_py()
        ids = np.frombuffer(row["ids"].as_buffer(), np.int64).reshape(-1, 2)
        q_ids = np.frombuffer(row["q_ids"].as_buffer(), np.int64).reshape(-1, 2)
        c = _integers_as(_matrix(row["matrix"], len(ids), dim), kind)
        q = _integers_as(_matrix(row["q_matrix"], len(q_ids), dim), kind)
        state = {name: np.frombuffer(row[name].as_buffer(), np.int64) for name in ("low", "shift", "need")}
        order = np.lexsort((ids[:, 0], ids[:, 1]))[: int((ids[:, 1] == 0).sum())]  # null ids are nobody's own
        ordered = ids[order, 0]
        for a in range(0, len(q), tile):
            s = _scores(q[a : a + tile], c)
            x, named = q_ids[a : a + tile, 0], q_ids[a : a + tile, 1] == 0
            left = np.searchsorted(ordered, x, "left")
            n = np.where(named, np.searchsorted(ordered, x, "right") - left, 0)
            hit = np.repeat(np.arange(len(x)), n)
            s[hit, order[np.repeat(left - np.cumsum(n) + n, n) + np.arange(len(hit))]] = -np.inf if s.dtype != np.int64 else np.iinfo(np.int64).min
            yield row["qb"].as_py(), int(row["q_first"].as_py()) + a, s, ids, {k: v[a : a + tile] for k, v in state.items()}


def _least(s: np.ndarray, k: int, groups: int = 64) -> np.ndarray | None:
    """For each row of scores a value that k of them reach at least: the kth of the greatest of `groups` stretches."""
    width = s.shape[1] // groups
    if width < 2 or k > groups:
        return None
    tops = s[:, : groups * width].reshape(len(s), groups, width).max(axis=2)
    return np.partition(tops, groups - k, axis=1)[:, groups - k]


def _count(bound: float, bins: int, tile: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qb, first, s, _, state in _cells(batch, bound, tile):
                low, shift, need = state["low"], state["shift"], state["need"]
                # scores above the interval were counted by an earlier round; none below a kth one can be the global kth
                high = np.minimum(low + (bins << shift) - 1, 2**24 if s.dtype == np.float32 else 2**53 if s.dtype == np.float64 else _BOUND)
                floor = low.astype(s.dtype)
                least = _least(s, k)
                if least is not None:
                    floor = np.maximum(floor, least)
                at, col = np.nonzero((s >= floor[:, None]) & (s <= high.astype(s.dtype)[:, None]))
                bin_ = (s[at, col].astype(np.int64) - low[at]) >> shift[at]
                counts = np.bincount(at * bins + bin_, minlength=len(s) * bins).reshape(len(s), bins)
                above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
                at, bin_ = np.nonzero((counts > 0) & (above < need[:, None]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), qb, np.int32)), pa.array((at + first).astype(np.int32)), pa.array(bin_.astype(np.int64)), pa.array(counts[at, bin_].astype(np.int64))], ["qb", "qi", "bin", "n"])

    return run


def _keep(bound: float, tile: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qb, first, s, ids, state in _cells(batch, bound, tile):
                value, need = state["low"].astype(s.dtype), state["need"]
                at, col = np.nonzero(s > value[:, None])
                tie, tied = np.nonzero(s == value[:, None])
                order = np.lexsort((ids[tied, 0], ids[tied, 1], tie))
                tie, tied = tie[order], tied[order]
                wanted = np.arange(len(tie)) - np.searchsorted(tie, tie, "left") < need[tie]
                at, col = np.concatenate([at, tie[wanted]]), np.concatenate([col, tied[wanted]])
                vec = pa.array(ids[col, 0], mask=ids[col, 1] == 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), qb, np.int32)), pa.array((at + first).astype(np.int32)), vec, pa.array(s[at, col].astype(np.int64))], ["qb", "qi", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, bins: int = 256, block: int = 4096, tile: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of vectors with the highest inner products of floor(scale * x) with each
    row of queries (both vec_id: integer, embedding: array of numbers), equal ones by ascending vec_id; all, if fewer.

    Vectors that are null or have a null or non-finite component take no part; vectors of different lengths have no
    product, empty ones have 0. A query's own are the rows with its id; a row without an id is nobody's own, comes last
    among equals and may be a query. Repeated rows count each as a candidate, and equal ones once as a query; one id with
    several vectors is as many queries. Components and scores beyond 2**62 - 1 count as that. Other columns are not read.
    No rows give no rows.
    """
    spark = vectors.sparkSession
    n_blocks = max(1, -(-queries.count() // block))
    asked = Table(_pack(queries.select("vec_id", "embedding").distinct().repartition(n_blocks), scale, block, True))
    held = Table(_pack(vectors, scale, block, False))

    def norm(of: Table) -> tuple[int, float]:
        """How many blocks, and the greatest Euclidean norm of a vector in them."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                top = [float(np.sqrt((_matrix(m, n.as_py(), d.as_py()).astype(np.float64) ** 2).sum(axis=1)).max()) for n, d, m in zip(*batch.columns, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(top, pa.float64())], ["top"])

        blocks, top = of.rows.select("n", "dim", "matrix").mapInArrow(run, "top double").agg(F.count("*"), F.max("top")).first()
        return int(blocks), float(top or 0)

    (n_asked, top_asked), (n_held, top_held) = norm(asked), norm(held)
    bound = (math.floor(top_asked * top_held) + 2) * (1 + 1e-9)
    lowest = -min(math.ceil(bound), _BOUND)
    step = bins.bit_length() - 1
    rounds = max(1, -(-(1 - 2 * lowest).bit_length() // step))
    shift = (rounds - 1) * step
    if shift + step > 62:
        lowest, shift = -_BOUND, 63 - step
    # a bucket has about one block of candidates; queries of one task are one after another in their block's numbers
    buckets = max(1, n_held)
    numbered = asked.rows.withColumn("q_first", F.sum("n").over(Window.partitionBy("qb").orderBy("dim", F.sha2("ids", 256), F.sha2("matrix", 256)).rowsBetween(Window.unboundedPreceding, -1)))
    asked_rows = Table(numbered.withColumn("q_first", F.coalesce("q_first", F.lit(0)).cast("int")).withColumnsRenamed({"ids": "q_ids", "matrix": "q_matrix", "n": "q_n"}))
    candidates = held.rows.drop("qb").withColumn("bucket", F.pmod(F.xxhash64("ids", "matrix"), F.lit(buckets)))
    candidates = candidates.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def cells(state: DataFrame) -> DataFrame:
        with_state = asked_rows.rows.join(state, ["qb", "q_first"])
        spread = with_state.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))))
        both = candidates.join(spread, ["qb", "bucket", "dim"])
        return both.select("qb", "dim", "ids", "matrix", "q_ids", "q_matrix", "q_first", "low", "shift", "need")

    def packed(one: DataFrame) -> DataFrame:
        """State of each query (qb, qi, low, shift, need) as arrays in the order of its block."""
        place = asked_rows.rows.select("qb", "q_first", (F.col("q_first") + F.col("q_n")).alias("_end"))
        near = place.join(one, "qb").filter("qi >= q_first and qi < _end")
        lists = near.groupBy("qb", "q_first").agg(F.array_sort(F.collect_list(F.struct("qi", "low", "shift", "need"))).alias("_s"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cols = [[np.array(x.as_py() or [], np.int64).tobytes() for x in batch.column(j)] for j in (2, 3, 4)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.binary()) for c in cols)], ["qb", "q_first", "low", "shift", "need"])

        return lists.select("qb", "q_first", "_s.low", "_s.shift", "_s.need").mapInArrow(run, "qb int, q_first int, low binary, shift binary, need binary")

    every = asked_rows.rows.select("qb", F.explode(F.sequence("q_first", F.col("q_first") + F.col("q_n") - 1)).alias("qi"))
    state = Table(every.select("qb", "qi", F.lit(lowest).cast("long").alias("low"), F.lit(shift).cast("long").alias("shift"), F.lit(k).cast("long").alias("need")))
    down = Window.partitionBy("qb", "qi").orderBy(F.desc("bin"))  # at most `bins` rows
    while True:
        counted = cells(packed(state.rows)).mapInArrow(_count(bound, bins, tile, k), "qb int, qi int, bin long, n long")
        sums = counted.groupBy("qb", "qi", "bin").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(down))
        # the first bin from the top that brings the count to what is wanted, or else, where candidates are fewer, none
        hit = sums.join(state.rows, ["qb", "qi"]).filter("upto >= need and upto - n < need")
        chosen = hit.select("qb", "qi", (F.col("low") + F.expr("shiftleft(bin, cast(shift as int))")).alias("_low"), (F.col("need") - F.col("upto") + F.col("n")).alias("_need"))
        after = state.rows.join(chosen, ["qb", "qi"], "left").select("qb", "qi", F.coalesce("_low", F.lit(lowest).cast("long")).alias("low"), F.lit(max(0, shift - step)).cast("long").alias("shift"), F.coalesce("_need", F.lit(k).cast("long")).alias("need"))
        last, state = state, Table(after)
        last.remove()
        if not shift:
            break
        shift = max(0, shift - step)
    kept = cells(packed(state.rows)).mapInArrow(_keep(bound, tile), "qb int, qi int, vec_id long, score long")
    names = asked_rows.rows.mapInArrow(_names, "qb int, qi int, query_id long")
    best = Window.partitionBy("qb", "qi").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    found = kept.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    out = Table(found.join(names, ["qb", "qi"]).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
    for table in (asked, held, asked_rows, state):
        table.remove()
    return out.rows


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number and id of each query of a block."""
    for batch in batches:
        where = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        for qb, first, ids in zip(where["qb"], where["q_first"], where["q_ids"], strict=True):
            x = np.frombuffer(ids.as_buffer(), np.int64).reshape(-1, 2)
            numbers = np.arange(len(x), dtype=np.int32) + first.as_py()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), qb.as_py(), np.int32)), pa.array(numbers, pa.int32()), pa.array(x[:, 0], mask=x[:, 1] == 1)], ["qb", "qi", "query_id"])
