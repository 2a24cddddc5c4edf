"""Exact ranked retrieval over dual-sorted posting lists, one wavelet tree a shard.

A shard is some megabytes of documents. Its posting lists lie one after another, each by descending impact, and a wavelet
tree over the document numbers keeps that order in every node, so a list's range within a node starts with its greatest
impact below that node: the sum over a query's terms bounds all documents there. Nodes are documents' intervals; they are
opened in order of their bounds, a leaf's bound being its document's score, until no bound reaches the kth score.
The tree is stored as one row of bits a level (all zeros' subtrees before the ones', so a range is followed by counts).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import kernels as K
from millrace.llm.store import Table

#: A term is a maximal run of ASCII letters, digits and characters beyond ASCII; bytes of the latter are 0x80 and more.
TERM = np.zeros(256, bool)
TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_SHARD = {"n_docs": "int", "n_postings": "long", "ids": "binary", "terms": "binary", "term_at": "binary", "starts": "binary", "impacts": "binary", "bits": "binary"}
_ITEMS = 256  # queries that are searched at a time


@dataclass
class Index:
    """Shards, the number of documents with a term, and of all their terms."""

    table: Table
    n: int
    total: int


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in lower case, and first byte, length and row of each term."""
    data, at = K.utf8(column)
    return K.LOWER[data], *K.runs(data, at, TERM)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs = terms = 0
        for i, j in K.slices(batch.column(0)):
            _, _, _, rows = _terms(batch.column(0).slice(i, j - i))
            docs, terms = docs + int(np.count_nonzero(np.diff(rows, prepend=-1))), terms + len(rows)
        yield pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([terms])], ["n", "total"])


def impact(tf: np.ndarray, n_terms: np.ndarray, n: int, total: int) -> np.ndarray:
    """What an occurrence count is worth in a document of so many terms, before the term's weight."""
    m = 100 - 25 + 25 * n_terms * n // total
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def build(ids: pa.Array, texts: pa.Array, n: int, total: int) -> pa.RecordBatch:
    """The shard of these documents, numbered by ascending id, null last."""
    data, starts, lengths, rows = _terms(texts)
    order = pc.sort_indices(pa.table({"id": ids}), sort_keys=[("id", "ascending")], null_placement="at_end").to_numpy().astype(np.int64)
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    code, terms = K.codes(data, starts, lengths)
    pairs, tf = np.unique(code * len(order) + number[rows], return_counts=True)
    term, doc = pairs // max(1, len(order)), pairs % max(1, len(order))
    worth = impact(tf.astype(np.int64), np.bincount(number[rows], minlength=len(order))[doc], n, max(1, total))
    by_worth = np.lexsort((doc, -worth, term))
    doc, worth = doc[by_worth], worth[by_worth]
    bits, now = [], doc
    for level in range(_levels(len(order)) - 1, -1, -1):
        one = (now >> level & 1).astype(bool)
        bits.append(np.packbits(one))
        now = np.concatenate([now[~one], now[one]])
    sorted_ids = ids.take(pa.array(order)).cast(pa.int64())
    null = pc.is_null(sorted_ids).to_numpy(zero_copy_only=False)
    known = pc.fill_null(sorted_ids, 0).to_numpy(zero_copy_only=False)
    cells = {
        "n_docs": len(order), "n_postings": len(doc), "ids": np.concatenate([known, null.astype(np.int64)]).tobytes(), "terms": b"".join(terms.to_pylist()), "term_at": np.cumsum([0, *pc.binary_length(terms).to_pylist()]).astype("<i4").tobytes(),
        "starts": np.searchsorted(term, np.arange(len(terms) + 1)).astype("<i4").tobytes(), "impacts": worth.astype("<u4").tobytes(), "bits": b"".join(b.tobytes() for b in bits),
    }
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 6]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(cells.values(), kinds, strict=True)], list(cells))


def _levels(n_docs: int) -> int:
    return max(1, (n_docs - 1).bit_length())


def index(docs: DataFrame, id: str = "doc_id", text: str = "text", shard_bytes: int = 4 << 20) -> Index:
    """Index of all rows of docs: a table of shards in the shared folder, of some `shard_bytes` of text each, or of one
    document. Null and empty texts, and those without a term, have no postings; a row without an id is a document too, as is
    each of several rows with one id. Other columns are not read."""
    texts = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    n, total = texts.select("text").mapInArrow(_sizes, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    n, total = int(n or 0), int(total or 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in K.slices(batch.column(1), shard_bytes):
                yield build(batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), n, total)

    return Index(Table(texts.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in _SHARD.items()))), n, total)


def _dictionary(row: dict) -> pa.Array:
    """The terms of a shard."""
    at = row["term_at"].as_buffer()
    return pa.Array.from_buffers(pa.binary(), at.size // 4 - 1, [None, at, row["terms"].as_buffer()])


class Shard:
    """A shard opened for queries: counts of zeros before each place of each level, and the impacts there."""

    def __init__(self, row: dict):
        n = row["n_postings"].as_py()
        self.n_docs, self.n = row["n_docs"].as_py(), n
        self.levels = _levels(self.n_docs)
        self.terms = _dictionary(row)
        self.starts = np.frombuffer(row["starts"].as_buffer(), "<i4").astype(np.int64)
        self.ids = np.frombuffer(row["ids"].as_buffer(), np.int64).reshape(2, -1)
        packed = np.frombuffer(row["bits"].as_buffer(), np.uint8).reshape(self.levels, -1)
        self.zeros = np.zeros((self.levels, n + 1), np.int32)
        self.impacts = np.zeros((self.levels + 1, max(1, n)), np.uint32)
        now = np.frombuffer(row["impacts"].as_buffer(), "<u4")
        self.impacts[0, :n] = now
        for level in range(self.levels):
            one = np.unpackbits(packed[level], count=n).astype(bool) if n else np.zeros(0, bool)
            np.cumsum(~one, out=self.zeros[level, 1:])
            now = np.concatenate([now[~one], now[one]])
            self.impacts[level + 1, :n] = now

    def ranges(self, terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """First place and end of each term's list; empty where the shard lacks it."""
        at = pc.index_in(terms, value_set=self.terms)
        known = pc.is_valid(at).to_numpy(zero_copy_only=False)
        at = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        return np.where(known, self.starts[at], 0), np.where(known, self.starts[np.minimum(at + 1, len(self.starts) - 1)], 0)

    def best(self, item: np.ndarray, lo: np.ndarray, hi: np.ndarray, weight: np.ndarray, k: int, floor: np.ndarray, width: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, document and score of all documents that can be among the k best of an item: those that reach floor
        and the item's kth score here. item (ascending), lo, hi and weight are an item's lists; floor is raised.

        The open nodes of all items are kept together. Each turn takes the `width` nodes of an item with the highest
        bounds and puts their children in their place; once leaves are reached, a turn takes twice as many as the last."""
        some = hi > lo
        item, lo, hi, weight = item[some], lo[some], hi[some], weight[some]
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        first = np.flatnonzero(np.diff(item, prepend=-1))
        node_item, size = item[first], np.diff(np.append(first, len(item)))
        level, prefix = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        bound = _sums(weight * self.impacts[0, lo], size)
        turns = 0
        while len(node_item):
            turn = np.lexsort((-bound, node_item))
            begins = np.searchsorted(node_item[turn], node_item[turn], "left")
            now = np.zeros(len(turn), bool)
            now[turn[np.arange(len(turn)) - begins < width]] = True
            turns += 1
            width *= 2 if turns >= self.levels else 1
            lists = np.repeat(now, size)
            a, b, w, deep = lo[lists], hi[lists], weight[lists], np.repeat(level[now], size[now])
            za, zb, z = self.zeros[deep, a].astype(np.int64), self.zeros[deep, b].astype(np.int64), self.zeros[deep, -1].astype(np.int64)
            new = []
            for one in (0, 1):
                x, y = (z + a - za, z + b - zb) if one else (za, zb)
                has = y > x
                owner = np.repeat(np.arange(int(now.sum())), size[now])[has]
                count = np.bincount(owner, minlength=int(now.sum()))
                there = count > 0
                new.append((node_item[now][there], count[there], level[now][there] + 1, prefix[now][there] * 2 + one, x[has], y[has], w[has], deep[has] + 1))
            i2, s2, l2, p2, x2, y2, w2, d2 = (np.concatenate(c) for c in zip(*new, strict=True))
            b2 = _sums(w2 * self.impacts[d2, x2], s2)
            leaf = l2 == self.levels
            if leaf.any():
                done.append((i2[leaf], p2[leaf], b2[leaf]))
                done = [_top(*(np.concatenate(c) for c in zip(*done, strict=True)), k)]
                items, _, scores = done[0]
                counts = np.bincount(items, minlength=len(floor))
                ends = np.cumsum(counts)
                full = np.flatnonzero(counts >= k)
                floor[full] = np.maximum(floor[full], scores[ends[full] - counts[full] + k - 1])
            rest, grown = ~now & (bound >= floor[node_item]), ~leaf & (b2 >= floor[i2])
            kept, more = np.repeat(rest, size), np.repeat(grown, s2)
            lo, hi, weight = np.concatenate([lo[kept], x2[more]]), np.concatenate([hi[kept], y2[more]]), np.concatenate([weight[kept], w2[more]])
            node_item, size, level, prefix, bound = (np.concatenate([c[rest], d[grown]]) for c, d in ((node_item, i2), (size, s2), (level, l2), (prefix, p2), (bound, b2)))
        if not done:
            z = np.zeros(0, np.int64)
            return z, z, z
        return done[0]


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of stretches of so many values, none empty."""
    return np.add.reduceat(values.astype(np.int64), np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0, np.int64)


def _top(item: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best documents of each item, equal scores by ascending number, items ascending."""
    order = np.lexsort((doc, -score, item))
    item, doc, score = item[order], doc[order], score[order]
    kept = np.arange(len(item)) - np.searchsorted(item, item, "left") < k
    return item[kept], doc[kept], score[kept]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(c)[i] for c, name in enumerate(batch.schema.names)}


def _document_counts(shards: Index, terms: pa.Array) -> np.ndarray:
    """In how many documents each term is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for row in _rows(batches):
            at = pc.index_in(terms, value_set=_dictionary(row))
            starts = np.frombuffer(row["starts"].as_buffer(), "<i4").astype(np.int64)
            known = np.flatnonzero(pc.is_valid(at).to_numpy(zero_copy_only=False))
            where = pc.fill_null(at, 0).to_numpy(zero_copy_only=False)[known]
            total[known] += starts[where + 1] - starts[where]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "df"])

    found = shards.table.rows.select("terms", "term_at", "starts").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(len(terms), np.int64)
    out[found.column("term").to_numpy()] = found.column("df").to_numpy()
    return out


def _search(shards: Index, texts: list[str | None], k: int) -> DataFrame:
    """q (place in texts), doc_id, score, rank of the k best documents of each of some texts."""
    data, starts, lengths, q = _terms(pa.array(texts, pa.string()))
    code, terms = K.codes(data, starts, lengths)
    terms = terms.cast(pa.binary())
    df = _document_counts(shards, terms)
    weight = np.array([math.floor(1000 * math.log((2 * shards.n + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    pairs, times = np.unique(q.astype(np.int64) * max(1, len(terms)) + code, return_counts=True)
    item, term = pairs // max(1, len(terms)), pairs % max(1, len(terms))
    worth = times * weight[term]
    item, term, worth = item[worth > 0], term[worth > 0], worth[worth > 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = np.ones(len(texts), np.int64)  # a score is above 0
        best: list = []
        for row in _rows(batches):
            shard = Shard(row)
            lo, hi = shard.ranges(terms)
            for a in range(0, len(texts), _ITEMS):
                x, y = np.searchsorted(item, [a, a + _ITEMS])
                t = term[x:y]
                i, doc, score = shard.best(item[x:y] - a, lo[t], hi[t], worth[x:y], k, floor[a : a + _ITEMS])
                best.append(np.stack([i + a, score, shard.ids[1, doc], shard.ids[0, doc]], axis=1))
            best = [_merge(np.concatenate(best), k)]
            done = best[0]
            counts = np.bincount(done[:, 0], minlength=len(texts))
            full = np.flatnonzero(counts >= k)
            floor[full] = np.maximum(floor[full], done[np.cumsum(counts)[full] - 1, 1])
        got = best[0] if best else np.zeros((0, 4), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 3], mask=got[:, 2] == 1), pa.array(got[:, 1])], ["q", "doc_id", "score"])

    found = shards.table.rows.mapInArrow(run, "q long, doc_id long, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _merge(rows: np.ndarray, k: int) -> np.ndarray:
    """The k best (item, score, whether the id is null, id) of each item."""
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], -rows[:, 1], rows[:, 0]))]
    return rows[np.arange(len(rows)) - np.searchsorted(rows[:, 0], rows[:, 0], "left") < k]


def search(shards: Index, items: DataFrame, k: int = 20, id: str = "item_id", text: str = "text", most: int = 4 << 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of the index with the highest scores above 0 for each row of items,
    equal scores by ascending doc_id, null last; all, if fewer. A term counts as often as the item has it.

    Items travel to the shards with the task, some `most` bytes of text at a time: more of them are searched in several
    passes over the index. Null and empty texts, and items without a known term, have no rows; each of several items with
    one id has its own. Other columns are not read.
    """
    spark = items.sparkSession
    out: list[DataFrame] = []
    names: list = []
    block: list = []

    def close() -> None:
        named = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "q long, item_id long")
        found = _search(shards, block, k).join(F.broadcast(named), "q")  # as many rows as the block has items
        out.append(found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
        names.clear()
        block.clear()

    size = 0
    for row in items.select(F.col(id).cast("long"), F.col(text)).toLocalIterator():
        names.append(row[0])
        block.append(row[1])
        size += len((row[1] or "").encode())
        if size >= most or len(block) >= 65536:
            close()
            size = 0
    if block or not out:
        close()
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole
