"""Binary token-id output: a concatenated id array with Elias-Fano encoded document boundaries.

Documents are range-partitioned by doc_id and sorted, so segments in order of (part, seg) hold the corpus in
ascending doc_id order. A segment is one self-contained binary value: a header, the ids (16 or 32 bits each), and
two monotone sequences in Elias-Fano form, the boundaries within the segment and the doc_ids less the first one.
Segments are the rows of a Parquet table, which gives them Spark's commit protocol on any Hadoop file system.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import encoding
from millrace.llm import kernels as K

MAGIC = b"EFIDSEG1"
_HEAD = struct.Struct("<8sBxxxIQqIII")
_EF = struct.Struct("<QQBxxxI")
STEP = 256  # ones between two select samples
DOCS = 64 * STEP  # documents that are read at a time


class EliasFano:
    """A monotone sequence of n values below 2**l * (ones and zeros of `high`): the low l bits of each in `low`, the
    rest in unary in `high`; `samples` has the place of every STEP-th one, so select needs a short scan."""

    def __init__(self, n: int, l: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.l, self.low, self.high, self.samples = n, l, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> "EliasFano":
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) + 1 if len(values) else 1
        l = max(0, (top // max(n, 1)).bit_length() - 1)
        ones = (values >> np.uint64(l)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        low = np.zeros((n, l), np.uint8)
        for j in range(l):
            low[:, j] = (values >> np.uint64(j)) & np.uint64(1)
        return cls(n, l, np.packbits(low.ravel()), np.packbits(bits), ones[::STEP].astype(np.uint32))

    def to_bytes(self) -> bytes:
        return _EF.pack(self.n, len(self.high), self.l, len(self.samples)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, b: bytes) -> "EliasFano":
        n, highs, l, samples = _EF.unpack_from(b)
        a = _EF.size
        c = a + (n * l + 7) // 8
        return cls(n, l, np.frombuffer(b, np.uint8, c - a, a), np.frombuffer(b, np.uint8, highs, c), np.frombuffer(b, np.uint32, samples, c + highs))

    def _lows(self, i: int, n: int) -> np.ndarray:
        if not self.l:
            return np.zeros(n, np.uint64)
        first = i * self.l
        bits = np.unpackbits(self.low[first // 8 : -(-(first + n * self.l) // 8)])[first % 8 :][: n * self.l].reshape(n, self.l)
        return (bits.astype(np.uint64) << np.arange(self.l, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """Value i, from the sample before it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = int(self.samples[i // STEP])
        byte, left = place // 8, i % STEP
        bits = np.unpackbits(self.high[byte : byte + 1])[place % 8 :]
        base = place
        while (n := int(bits.sum())) <= left:
            left -= n
            base += len(bits)
            byte += 1
            bits = np.unpackbits(self.high[byte : byte + 1])
        place = base + int(np.flatnonzero(bits)[left])
        return (place - i) << self.l | int(self._lows(i, 1)[0])

    def between(self, i: int, j: int) -> np.ndarray:
        """Values i to j - 1, from the bits between the samples around them."""
        if i >= j:
            return np.zeros(0, np.int64)
        before, after = i // STEP, -(-j // STEP)
        place = int(self.samples[before])
        byte, end = place // 8, int(self.samples[after]) // 8 + 1 if after < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[byte:end])[place % 8 :])[i - before * STEP : j - before * STEP] + place
        return ((ones - np.arange(i, j)).astype(np.uint64) << np.uint64(self.l) | self._lows(i, j - i)).astype(np.int64)

    def values(self) -> np.ndarray:
        """All values."""
        return self.between(0, self.n)


def pack_segment(doc_ids: list[int | None], ids: np.ndarray, offsets: np.ndarray) -> bytes:
    """doc_ids ascending, null ones first; offsets: one more than documents, from 0."""
    nulls = sum(x is None for x in doc_ids)
    known = np.array(doc_ids[nulls:], np.int64)
    base = int(known[0]) if len(known) else 0
    narrow = not len(ids) or int(ids.max()) < 1 << 16
    bounds, names = EliasFano.build(offsets).to_bytes(), EliasFano.build((known - base).astype(np.uint64)).to_bytes()
    return _HEAD.pack(MAGIC, 2 if narrow else 4, len(doc_ids), len(ids), base, nulls, len(bounds), len(names)) + bounds + names + ids.astype("<u2" if narrow else "<u4").tobytes()


class Segment:
    """A packed segment; doc(i) reads one document through the select structure."""

    def __init__(self, b: bytes):
        magic, self.width, self.n_docs, self.n_ids, self.base, self.nulls, bounds, names = _HEAD.unpack_from(b)
        if magic != MAGIC:
            raise ValueError("not a segment of ids")
        a = _HEAD.size
        self.bounds = EliasFano.from_bytes(b[a : a + bounds])
        self.names = EliasFano.from_bytes(b[a + bounds : a + bounds + names])
        self.ids = np.frombuffer(b, "<u2" if self.width == 2 else "<u4", self.n_ids, a + bounds + names)

    def doc(self, i: int) -> tuple[int | None, np.ndarray]:
        name = None if i < self.nulls else self.base + self.names.select(i - self.nulls)
        return name, self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]

    def docs(self, i: int, j: int) -> tuple[list[int | None], np.ndarray]:
        """doc_ids of documents i to j - 1, and the j - i + 1 offsets that bound them."""
        names = self.names.between(max(i - self.nulls, 0), max(j - self.nulls, 0)) + self.base
        return [None] * max(0, min(j, self.nulls) - i) + names.tolist(), self.bounds.between(i, j + 1)


def write(docs: DataFrame, path: str, tokenizer: str, end: int = 0, parts: int | None = None, ids_per_segment: int = 4_000_000) -> None:
    """Encode text of docs (doc_id, text) and write the segments to path.

    Null text is empty and has the end id alone; null doc_ids come first; repeated doc_ids are kept, in order of
    their texts' hash. An empty table writes no segment. A document longer than a segment gets one of its own.
    """
    n = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "text").repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoding.encoder(tokenizer, True), TaskContext.get().partitionId()
        names: list[int | None] = []
        pieces: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        held = seg = 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(pieces)
            blob = pack_segment(names, ids, np.concatenate([[0], np.cumsum(np.concatenate(lengths))]))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seg], pa.int32()), pa.array([len(names)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([blob], pa.binary())], ["part", "seg", "n_docs", "n_ids", "segment"])

        for batch in batches:
            text, doc = batch.column(1), batch.column(0).to_pylist()
            for i, j in K.slices(text):
                ids, at = enc.encode(text.slice(i, j - i), end)
                names += doc[i:j]
                pieces.append(ids)
                lengths.append(np.diff(at))
                held += len(ids)
                if held >= ids_per_segment:
                    yield flush()
                    seg += 1
                    names, pieces, lengths, held = [], [], [], 0
        if names:
            yield flush()

    ordered.mapInArrow(segments, "part int, seg int, n_docs long, n_ids long, segment binary").write.parquet(path)


def read(spark, path: str) -> DataFrame:
    """Documents of a written table: doc_id, start (ids of all documents before it), n_tokens, ids_crc32. Segments are
    read DOCS documents at a time, whose offsets the select samples give, so no table of all offsets is made."""
    table = spark.read.parquet(path)
    by_part = table.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = by_part.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("part").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    starts = table.select("part", "seg", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("_in")).join(base, "part").select("part", "seg", (F.col("_base") + F.col("_in")).alias("start"))

    def docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seg, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                s = Segment(blob.as_py())
                for i in range(0, s.n_docs, DOCS):
                    names, at = s.docs(i, min(i + DOCS, s.n_docs))
                    crc = [zlib.crc32(s.ids[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    n = len(crc)
                    yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([seg] * n, pa.int32()), pa.array(names, pa.int64()), pa.array(at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["part", "seg", "doc_id", "_at", "n_tokens", "ids_crc32"])

    rows = table.select("part", "seg", "segment").mapInArrow(docs, "part int, seg int, doc_id long, _at long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "seg"]).select("doc_id", (F.col("start") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32")
