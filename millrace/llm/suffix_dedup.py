"""Exact substring dedup with a logarithmic family of sorted tables of sampled strings.

A byte goes if a string of `length` bytes over it also starts earlier, in a document before or in the same one.

1. Texts that equal an earlier one whole are settled by their hashes; only firsts go on.
2. Of the k-grams in each `length`-byte string one is its anchor (the least by hash, the leftmost of equals), so
   equal strings have equal anchors at the same place. They are dealt by the hash of the anchor.
3. In a part, each batch of anchors is a table sorted by hash (no suffix order, as only equality matters), is looked up
   in the tables of earlier batches, and tables of about equal size merge, so there are never more than a logarithm of
   them. Anchors that occur once in the corpus are done with here, without any text.
4. For the others the text around them is dealt by the same hash in document order, and the same family, now over the
   whole `length`-byte strings, tells each string that has come before. Only distinct strings are kept, so a passage
   in a third of all documents takes the room of one.

Strings are compared by two hashes of 64 bits of their bytes, anchors, which only choose what is looked at, by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import kernels as K


def rolling(data: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of the k bytes from each place; one for each place that has so many, another for each salt. Eight bytes are taken at once; a hash of
    twice as many is made of two, the left one mixed, so that it is no sum of powers, in which unequal bytes cancel out."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    each = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,)).astype(np.uint64)
    if k < 8:
        return K.mix(each[:n] & np.uint64((1 << 8 * k) - 1), k + salt)
    value, width, out, done = K.mix(each, 3 + salt), 8, None, 0
    while True:
        if k & width:  # the part of this width comes after what is done
            part = value[done : done + n]
            out, done = part if out is None else K.mix(out, 4) + part, done + width
        if 2 * width > k:
            break
        value = K.mix(value[:-width], width) + value[width:]
        width *= 2
    if done < k:
        out = K.mix(out, 5) + each[k - 8 : k - 8 + n]
    return K.mix(out, k)


def window_min(values: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive values."""
    n = len(values) - w + 1
    padded = np.full(-(-len(values) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, at: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and place of each anchor, and the first and last string it stands for (by where they start)."""
    z = np.zeros(0, np.int64)
    if len(data) < length:
        return np.zeros(0, np.uint64), z, z, z
    hashes = rolling(data, k)
    bits = np.uint64(max(1, int(len(hashes)).bit_length()))
    chosen = window_min((hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64), length - k + 1)
    chosen = (chosen & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    starts = np.arange(len(data) - length + 1)
    end = np.repeat(at[1:], np.diff(at))[: len(starts)]
    whole = starts + length <= end
    starts, chosen = starts[whole], chosen[whole]
    if not len(starts):
        return np.zeros(0, np.uint64), z, z, z
    new = np.ones(len(starts), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(starts) - 1]])
    return hashes[chosen[first]], chosen[first], starts[first], starts[last]


class Family:
    """Sorted arrays of keys with a place each. insert() adds the keys of a batch; arrays merge when the newer one has
    half the size of the one before or more, so their sizes grow geometrically."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.apart: set[tuple[int, int]] = set()

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
        """Whether each key (ascending) is known, and where: (level, which keys, index in the level)."""
        known, where = np.zeros(len(keys), bool), []
        for level, (have, _) in enumerate(self.levels):
            at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
            hit = np.flatnonzero(have[at] == keys)
            if len(hit):
                known[hit] = True
                where.append((level, hit, at[hit]))
        return known, where

    def seen(self, keys: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Whether each of distinct pairs, ascending, was there before; those that were not are added. The places of this
        family are the second numbers; pairs whose first number another one has already are kept apart, as they are few."""
        known, where = self.look(keys)
        same = np.zeros(len(keys), bool)
        for level, hit, at in where:
            same[hit] = self.levels[level][1][at] == others[hit]
        free = ~known
        free[1:] &= keys[1:] != keys[:-1]
        for i in np.flatnonzero(~same & ~free).tolist():
            pair = int(keys[i]), int(others[i])
            same[i] = pair in self.apart
            self.apart.add(pair)
        self.insert(keys[free], others[free])
        return same

    def insert(self, keys: np.ndarray, places: np.ndarray) -> None:
        if not len(keys):
            return
        self.levels.append((keys, places))
        while len(self.levels) > 1 and 2 * len(self.levels[-1][0]) >= len(self.levels[-2][0]):
            b, a = self.levels.pop(), self.levels.pop()
            to = np.searchsorted(a[0], b[0])
            self.levels.append((np.insert(a[0], to, b[0]), np.insert(a[1], to, b[1])))


def _runs_of(starts: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and end of the stretches that strings at ascending starts cover together."""
    new = np.ones(len(starts), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (starts[1:] > starts[:-1] + length)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(starts) - 1]]) if len(first) else first
    return doc[first], starts[first], starts[last] + length


def dedup(docs: DataFrame, length: int = 100, k: int = 32, parts: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and spans (arrays of start and end in
    bytes) of each row of docs (doc_id, text).

    Null text is empty; texts under `length` bytes lose nothing; equal doc_ids are ordered by their texts' hash, of
    equal rows one counts as first; a null doc_id comes before all others. An empty table gives an empty table.
    """
    n = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(text).alias("t"), text.alias("text"))
    firsts = rows.select("d", "t", F.xxhash64(F.lit(1), "text").alias("t2")).groupBy("t", "t2").agg(F.min("d").alias("d")).select("d", "t", F.lit(1).alias("one"))
    nth = F.row_number().over(Window.partitionBy("d", "t").orderBy("t"))
    held = rows.repartition(n, "d", "t").withColumn("nth", nth).join(firsts.dropDuplicates(["d", "t"]), ["d", "t"], "left")
    held = held.withColumn("first", F.col("one").isNotNull() & (F.col("nth") == 1)).select("d", "t", "doc_id", "text", "first")

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in K.slices(batch.column(2), 2 << 20):
                data, at = K.utf8(batch.column(2).slice(i, j - i))
                h, place, _, _ = anchors(data, at, length, k)
                if not len(h):
                    continue
                doc = np.searchsorted(at, place, "right") - 1
                part = (h >> np.uint64(32)).astype(np.int64) % n
                order = np.argsort(part, kind="stable")
                edges = np.searchsorted(part[order], np.arange(n + 1))
                d, t = batch.column(0).to_numpy()[i:j], batch.column(1).to_numpy()[i:j]
                out = []
                for p in range(n):
                    mine = order[edges[p] : edges[p + 1]]
                    if len(mine):
                        used, local = np.unique(doc[mine], return_inverse=True)
                        # documents ascend, so how many anchors each has tells whose they are; 40 bits of a hash are enough in a part
                        out.append((p, K.planes(d[used], 8), t[used].tobytes(), K.planes(np.bincount(local), 4), K.planes(place[mine] - at[doc[mine]], 4), K.planes(h[mine], 5)))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), *(pa.array([x[c] for x in out], pa.binary()) for c in range(1, 6))], ["part", "d", "t", "times", "place", "h"])

    sampled = held.filter("first").select("d", "t", "text").mapInArrow(sample, "part int, d binary, t binary, times binary, place binary, h binary")

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        families: dict[int, tuple[Family, list]] = {}
        for batch in batches:
            part = batch.column(0).to_numpy()
            for p in np.unique(part):
                family, store = families.setdefault(int(p), (Family(), [np.zeros((0, 3), np.int64), np.zeros(0, bool)]))
                got = [[], [], [], []]
                for r in np.flatnonzero(part == p):
                    d, t, times, place, h = (K.unplanes(batch.column(c)[int(r)].as_py(), width) if width else np.frombuffer(batch.column(c)[int(r)].as_py(), np.int64) for c, width in enumerate((8, 0, 4, 4, 5), 1))
                    of = np.repeat(np.arange(len(t)), times.astype(np.int64))
                    for x, y in zip(got, (d.view(np.int64)[of], t[of], place.astype(np.int64), h), strict=True):
                        x.append(y)
                d, t, place, h = (np.concatenate(x) for x in got)
                order = np.argsort(h, kind="stable")
                d, t, place, h = d[order], t[order], place[order], h[order]
                keys, first, times = np.unique(h, return_index=True, return_counts=True)
                known, where = family.look(keys)
                twice = np.repeat(known | (times > 1), times)
                out = [np.stack([d[twice], t[twice], place[twice]], axis=1)]
                for level, _, at in where:  # their first occurrence, unless told before
                    slots = family.levels[level][1][at]
                    fresh = slots[~store[1][slots]]
                    out.append(store[0][fresh])
                    store[1][fresh] = True
                new = ~known
                slots = len(store[0]) + np.arange(int(new.sum()))
                store[0] = np.concatenate([store[0], np.stack([d, t, place], axis=1)[first[new]]])
                store[1] = np.concatenate([store[1], times[new] > 1])
                family.insert(keys[new], slots)
                all_ = np.concatenate(out)
                if len(all_):
                    all_ = all_[np.lexsort((all_[:, 2], all_[:, 1], all_[:, 0]))]
                    change = np.flatnonzero((np.diff(all_[:, :2], axis=0) != 0).any(axis=1)) + 1
                    edge = np.concatenate([[0], change, [len(all_)]])
                    yield pa.RecordBatch.from_arrays([pa.array(all_[edge[:-1], 0]), pa.array(all_[edge[:-1], 1]), pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(all_[:, 2].astype(np.int32)))], ["d", "t", "places"])

    hits = sampled.repartition(n, "part").mapInArrow(repeated, "d long, t long, places array<int>").groupBy("d", "t").agg(F.flatten(F.collect_list("places")).alias("places"))
    around = held.filter("first").select("d", "t", "text").join(hits, ["d", "t"]).select("d", "t", "text", "places")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in K.slices(batch.column(2), 2 << 20):
                data, at = K.utf8(batch.column(2).slice(i, j - i))
                h, place, lo, hi = anchors(data, at, length, k)
                doc = np.searchsorted(at, place, "right") - 1
                lists = batch.column(3).slice(i, j - i)
                sizes = np.diff(lists.offsets.to_numpy())
                wanted = np.unique(lists.flatten().to_numpy().astype(np.int64) + np.repeat(at[:-1], sizes))
                keep = np.isin(place, wanted)
                h, doc, lo, hi = h[keep], doc[keep], lo[keep], hi[keep]
                part = (h >> np.uint64(32)).astype(np.int64) % n
                order = np.lexsort((lo, part, doc))
                h, doc, lo, hi, part = h[order], doc[order], lo[order], hi[order], part[order]
                cut = np.ones(len(h), bool)
                cut[1:] = (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])
                edge = np.concatenate([np.flatnonzero(cut), [len(h)]])
                size = hi - lo + length
                whole = data[np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))].tobytes()
                ends = np.concatenate([[0], np.cumsum(size)])
                start = (lo - at[doc]).astype(np.uint32)
                if len(edge) > 1:
                    a, b = edge[:-1], edge[1:]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(part[a], pa.int32()), batch.column(0).slice(i, j - i).take(pa.array(doc[a])), batch.column(1).slice(i, j - i).take(pa.array(doc[a])),
                        pa.array([start[x:y].tobytes() for x, y in zip(a, b, strict=True)], pa.binary()), pa.array([size[x:y].astype(np.uint32).tobytes() for x, y in zip(a, b, strict=True)], pa.binary()), pa.array([whole[ends[x] : ends[y]] for x, y in zip(a, b, strict=True)], pa.binary()),
                    ], ["part", "d", "t", "start", "size", "bytes"])

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        families: dict[int, Family] = {}
        for whole in batches:
            for a, b in K.slices(whole.column(5), 1 << 20):
                batch = whole.slice(a, b - a)
                part = batch.column(0).to_numpy()
                for p in np.unique(part):
                    mine = np.flatnonzero(part == p)
                    family = families.setdefault(int(p), Family())
                    starts = [np.frombuffer(batch.column(3)[int(r)].as_py(), np.uint32) for r in mine]
                    size = np.concatenate([np.frombuffer(batch.column(4)[int(r)].as_py(), np.uint32) for r in mine]).astype(np.int64)
                    data = np.frombuffer(b"".join(batch.column(5)[int(r)].as_py() for r in mine), np.uint8)
                    row = np.repeat(mine, [len(x) for x in starts])
                    count = size - length + 1
                    begin = np.cumsum(size) - size
                    inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                    places = np.repeat(begin, count) + inner
                    key, other = rolling(data, length)[places], rolling(data, length, 1000)[places]
                    at = np.repeat(np.concatenate(starts).astype(np.int64), count) + inner
                    of = np.repeat(row, count)
                    order = np.lexsort((at, of, other, key))  # rows come in document order
                    key, other, at, of = key[order], other[order], at[order], of[order]
                    new = np.ones(len(key), bool)
                    new[1:] = (key[1:] != key[:-1]) | (other[1:] != other[:-1])
                    first = np.flatnonzero(new)
                    known = family.seen(key[first], other[first])
                    gone = np.repeat(known, np.diff(np.append(first, len(key)))) | ~new
                    at, of = at[gone], of[gone]
                    order = np.lexsort((at, of))
                    doc, lo, hi = _runs_of(at[order], of[order], length)
                    if len(doc):
                        cut = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1, [len(doc)]])
                        which = pa.array(doc[cut[:-1]])
                        off = pa.array(cut, pa.int32())
                        yield pa.RecordBatch.from_arrays([batch.column(1).take(which), batch.column(2).take(which), pa.ListArray.from_arrays(off, pa.array(lo)), pa.ListArray.from_arrays(off, pa.array(hi))], ["d", "t", "lo", "hi"])

    spans = around.mapInArrow(contexts, "part int, d long, t long, start binary, size binary, bytes binary").repartition(n, "part").sortWithinPartitions("d", "t").mapInArrow(removed, "d long, t long, lo array<long>, hi array<long>")
    spans = spans.groupBy("d", "t").agg(F.flatten(F.collect_list("lo")).alias("lo"), F.flatten(F.collect_list("hi")).alias("hi"))
    final = held.join(spans, ["d", "t"], "left").select("doc_id", "text", "first", "lo", "hi")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, first, lo, hi in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3), batch.column(4), strict=True):
                raw = text.as_py().encode()
                runs: list[list[int]] = []
                if not first:
                    runs = [[0, len(raw)]] if len(raw) >= length else []
                elif lo.is_valid:
                    a, b = lo.values.to_numpy(), hi.values.to_numpy()
                    order = np.argsort(a, kind="stable")
                    a, b = a[order], np.maximum.accumulate(b[order])
                    new = np.ones(len(a), bool)
                    new[1:] = a[1:] > b[:-1]
                    at = np.flatnonzero(new)
                    runs = np.stack([a[at], b[np.concatenate([at[1:] - 1, [len(a) - 1]])]], axis=1).tolist()
                digest, done, gone = hashlib.sha256(), 0, 0
                for a, b in runs:
                    digest.update(raw[done:a])
                    done = b
                    gone += b - a
                digest.update(raw[done:])
                out.append((len(raw), gone, len(runs), digest.hexdigest(), runs))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[c] for x in out], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())))))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return final.mapInArrow(finish, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>")
