"""Spark data source for shards of token sequences: <name>_<n>.bin with the values, <name>_<n>.idx with their index.

    spark.dataSource.register(BinIdx)
    spark.read.format("binidx").option("path", uri).option("name", "data").load()   # idx, shard, local_idx, tokens
    rows.repartition("shard").sortWithinPartitions("shard", "local_idx").write.format("binidx").option(...).mode("append").save()
    spark.readStream.format("binidx").option("path", uri).option("rowsPerBatch", 100_000).load()

Shards are read in order of their number up to the first gap, each in slices that are tasks of their own. Conditions on
idx, shard and local_idx choose the shards and rows that are read at all, with the option pushdown=true and the session's
spark.sql.python.filterPushdown.enabled, which where() sets: of a row, its entry in the index and its own bytes are fetched. fetch() does so
for a table of ids. Paths may be local or any URI that Arrow's file systems open. Written shards appear under their names
only when the job commits.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

from millrace.operators import sequences

#: Fixed values of the file format: magic bytes, and the code of each element type.
MAGIC = b"MMIDIDX\x00\x00"
OLD_MAGIC = b"TNTIDX\x00\x00"
CODES = {1: np.uint8, 2: np.int8, 3: np.int16, 4: np.int32, 5: np.int64, 6: np.float32, 7: np.float64, 8: np.uint16}

ROWS = 4096  # sequences in a batch


def best_code(vocab_size: int | None) -> int:
    """The type code for ids below vocab_size: 16 bits unsigned if they fit with room, else 32."""
    return 8 if vocab_size is not None and vocab_size < 65500 else 4


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def old_index_bytes(shapes: list[tuple[int, ...]], code: int, documents: np.ndarray | None = None) -> bytes:
    """The index of the older layout: items of any number of dimensions, with places counted in elements."""
    documents = np.zeros(1, "<i8") if documents is None else np.asarray(documents, "<i8")
    dims = np.cumsum([0, *(len(s) for s in shapes)]).astype("<i8")
    at = np.cumsum([0, *(int(np.prod(s, dtype=np.int64)) for s in shapes)]).astype("<i8")
    sizes = np.array([n for s in shapes for n in s], "<i8")
    return OLD_MAGIC + struct.pack("<QQQQQQ", 1, code, np.dtype(CODES[code]).itemsize, len(shapes), len(sizes), len(documents)) + dims.tobytes() + at.tobytes() + sizes.tobytes() + documents.tobytes()


def index_bytes(sizes: np.ndarray, code: int, documents: np.ndarray | None = None) -> bytes:
    sizes = np.asarray(sizes, "<i4")
    documents = np.zeros(1, "<i8") if documents is None else np.asarray(documents, "<i8")
    at = np.zeros(len(sizes), "<i8")
    np.cumsum(sizes[:-1].astype("<i8") * np.dtype(CODES[code]).itemsize, out=at[1:])
    return MAGIC + struct.pack("<QBQQ", 1, code, len(sizes), len(documents)) + sizes.tobytes() + at.tobytes() + documents.tobytes()


@dataclass
class Index:
    code: int
    sizes: np.ndarray
    at: np.ndarray  # bytes
    documents: np.ndarray

    @classmethod
    def parse(cls, b: bytes) -> "Index":
        if b.startswith(MAGIC):
            version, code, n, d = struct.unpack_from("<QBQQ", b, len(MAGIC))
            if version != 1:
                raise ValueError(f"version {version}")
            o = len(MAGIC) + 25
            return cls(code, np.frombuffer(b, "<i4", n, o), np.frombuffer(b, "<i8", n, o + 4 * n), np.frombuffer(b, "<i8", d, o + 12 * n))
        if b.startswith(OLD_MAGIC):  # an item of several dimensions is read as one sequence of all its elements
            o = len(OLD_MAGIC)
            _, code, width, n, s, d = struct.unpack_from("<QQQQQQ", b, o)
            o += 48
            at = np.frombuffer(b, "<i8", n + 1, o + 8 * (n + 1))
            return cls(code, np.diff(at), at[:-1] * width, np.frombuffer(b, "<i8", d, o + 16 * (n + 1) + 8 * s))
        raise ValueError("not an index of sequences")


def shard_numbers(path: str, name: str) -> list[int]:
    """Numbers that have both files, from the least up to the first gap."""
    system, root = open_path(path)
    names = {x.base_name for x in system.get_file_info(fs.FileSelector(root))}
    found = sorted(int(m[1]) for x in names if (m := re.fullmatch(rf"{re.escape(name)}_(\d+)\.idx", x)) and f"{x[:-4]}.bin" in names)
    return [n for i, n in enumerate(found) if n == found[0] + i]


def count_rows(path: str, name: str, shard: int) -> int:
    """How many sequences a shard has, from the head of its index alone."""
    system, root = open_path(path)
    with system.open_input_stream(f"{root}/{name}_{shard}.idx") as f:
        head = f.read(len(OLD_MAGIC) + 48)
    if head.startswith(MAGIC):
        return struct.unpack_from("<QBQQ", head, len(MAGIC))[2]
    if head.startswith(OLD_MAGIC):
        return struct.unpack_from("<QQQQQQ", head, len(OLD_MAGIC))[3]
    raise ValueError("not an index of sequences")


def read_index(path: str, name: str, shard: int) -> Index:
    system, root = open_path(path)
    with system.open_input_stream(f"{root}/{name}_{shard}.idx") as f:
        return Index.parse(f.read())


def fetched(f: pa.NativeFile, start: np.ndarray, length: np.ndarray, gap: int = 0) -> np.ndarray:
    """The bytes of ascending stretches of a file one after another. Stretches no more than `gap` bytes apart are read
    together, others by themselves."""
    some = length > 0
    start, length = start[some].astype(np.int64), length[some].astype(np.int64)
    if not len(start):
        return np.zeros(0, np.uint8)
    end = start + length
    first = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1] + gap]))
    last = np.append(first[1:], len(start)) - 1
    parts = [np.frombuffer(f.read_at(int(end[b] - start[a]), int(start[a])), np.uint8) for a, b in zip(first, last, strict=True)]
    data = np.concatenate(parts)
    if len(data) == length.sum():
        return data
    shift = np.repeat(start[first] - np.cumsum([0, *(len(x) for x in parts[:-1])]), last - first + 1)
    ends = np.cumsum(length)
    return data[np.repeat(start - shift - ends + length, length) + np.arange(int(ends[-1]))]


def read_places(path: str, name: str, shard: int, first: int, last: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Type code, sizes and byte offsets of the sequences from first to last, reading no more of the index than that."""
    return read_some_places(path, name, shard, np.arange(first, last))


def read_some_places(path: str, name: str, shard: int, rows: np.ndarray, gap: int = 0) -> tuple[int, np.ndarray, np.ndarray]:
    """The same of ascending rows."""
    system, root = open_path(path)
    with system.open_input_file(f"{root}/{name}_{shard}.idx") as f:
        head = f.read_at(len(MAGIC) + 25, 0)
        if not head.startswith(MAGIC):
            index = read_index(path, name, shard)
            return index.code, index.sizes[rows], index.at[rows]
        version, code, n, _ = struct.unpack_from("<QBQQ", head, len(MAGIC))
        if version != 1:
            raise ValueError(f"version {version}")
        sizes = fetched(f, len(head) + 4 * rows, np.full(len(rows), 4), gap)
        places = fetched(f, len(head) + 4 * n + 8 * rows, np.full(len(rows), 8), gap)
        return code, sizes.view("<i4"), places.view("<i8")


def read_rows(path: str, name: str, shard: int, base: int, rows: np.ndarray, gap: int = 0) -> Iterator[pa.RecordBatch]:
    """idx, shard, local_idx, tokens of ascending rows of a shard whose first row has the number base."""
    system, root = open_path(path)
    with system.open_input_file(f"{root}/{name}_{shard}.bin") as f:
        for a in range(0, len(rows), ROWS):
            some = rows[a : a + ROWS].astype(np.int64)
            code, sizes, at = read_some_places(path, name, shard, some, gap)
            kind = np.dtype(CODES[code]).newbyteorder("<")
            values = fetched(f, at, sizes.astype(np.int64) * kind.itemsize, gap).view(kind).astype(np.int64)
            tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays([pa.array(base + some), pa.array(np.full(len(some), shard, np.int32)), pa.array(some.astype(np.int32)), tokens], ["idx", "shard", "local_idx", "tokens"])


SCHEMA = "idx long, shard int, local_idx int, tokens array<long>"


class Slice(InputPartition):
    """Rows of a shard: from first to last, or those that are listed."""

    def __init__(self, shard: int, first: int, last: int, base: int, listed: np.ndarray | None = None):
        super().__init__((shard, first, last, base))
        self.shard, self.first, self.last, self.base, self.listed = shard, first, last, base, listed

    @property
    def rows(self) -> np.ndarray:
        return np.arange(self.first, self.last) if self.listed is None else self.listed


class Slices(InputPartition):
    """Slices that one task reads in order."""

    def __init__(self, parts: list[Slice]):
        super().__init__(parts)


class Chosen:
    """Conditions on idx, shard and local_idx, all of which hold."""

    def __init__(self, low: int = 0, high: int = 1 << 62):
        self.low, self.high = {"idx": low, "shard": 0, "local_idx": 0}, {"idx": high, "shard": 1 << 62, "local_idx": 1 << 62}  # high is excluded
        self.listed: dict[str, np.ndarray] = {}

    def add(self, condition: ds.Filter) -> bool:
        """Whether the condition is one of these, and so taken."""
        column = condition.attribute[0] if getattr(condition, "attribute", None) and len(condition.attribute) == 1 else None
        if column not in self.low:
            return False
        if isinstance(condition, ds.IsNotNull):
            return True
        if isinstance(condition, (ds.EqualTo, ds.In)):
            values = condition.value if isinstance(condition, ds.In) else [condition.value]
            values = np.unique(np.array([v for v in values if v is not None], np.int64))
            self.listed[column] = np.intersect1d(self.listed[column], values) if column in self.listed else values
        elif isinstance(condition, (ds.GreaterThan, ds.GreaterThanOrEqual)):
            self.low[column] = max(self.low[column], condition.value + isinstance(condition, ds.GreaterThan))
        elif isinstance(condition, (ds.LessThan, ds.LessThanOrEqual)):
            self.high[column] = min(self.high[column], condition.value + isinstance(condition, ds.LessThanOrEqual))
        else:
            return False
        return True

    def has_shard(self, shard: int) -> bool:
        return self.low["shard"] <= shard < self.high["shard"] and ("shard" not in self.listed or shard in self.listed["shard"])

    def rows(self, n: int, base: int) -> tuple[int, int, np.ndarray | None]:
        """First and last row of a shard of n rows, and which of these, if not all."""
        a = max(0, self.low["idx"] - base, self.low["local_idx"])
        b = max(a, min(n, self.high["idx"] - base, self.high["local_idx"]))
        listed = None
        for column, shift in (("idx", base), ("local_idx", 0)):
            if column in self.listed:
                found = self.listed[column] - shift
                listed = found if listed is None else np.intersect1d(listed, found)
        return a, b, None if listed is None else listed[(listed >= a) & (listed < b)]


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.name = options["path"].rstrip("/"), options.get("name", "data")
        self.per_task, self.gap = int(options.get("rowsPerTask", 100_000)), int(options.get("gapBytes", 1 << 16))
        self.chosen = Chosen(int(options.get("low", 0)), int(options.get("high", 1 << 62)))

    def partitions(self) -> list[Slice]:
        out, base = [], 0
        for shard in shard_numbers(self.path, self.name):
            if base >= self.chosen.high["idx"] or shard >= self.chosen.high["shard"]:
                break
            n = count_rows(self.path, self.name, shard)
            if self.chosen.has_shard(shard):
                a, b, listed = self.chosen.rows(n, base)
                if listed is None:
                    out += [Slice(shard, i, min(i + self.per_task, b), base) for i in range(a, b, self.per_task)]
                else:
                    out += [Slice(shard, a, b, base, listed[i : i + self.per_task]) for i in range(0, len(listed), self.per_task)]
            base += n
        return out or [Slice(-1, 0, 0, 0)]

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        if part.shard >= 0:
            yield from read_rows(self.path, self.name, part.shard, part.base, part.rows, self.gap)


class FilteringReader(Reader):
    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        return [f for f in filters if not self.chosen.add(f)]


class StreamReader(DataSourceStreamReader):
    """Shards as they appear, row by row: an offset is the shard and row that come next. A micro-batch has at most
    `rowsPerBatch` rows. A shard that is begun stays as it is; shards are added in order of their numbers.

    Spark does not tell a source where a restarted query stands when it asks for the next offset. `checkpoint`, the
    query's checkpointLocation, has it in the log of offsets; without that option the first batch after a start is all
    that is there, whatever `rowsPerBatch` says. Each row is in one batch either way.
    """

    def __init__(self, options: dict):
        self.path, self.name = options["path"].rstrip("/"), options.get("name", "data")
        self.per_batch, self.per_task = int(options.get("rowsPerBatch", 1_000_000)), int(options.get("rowsPerTask", 100_000))
        self.checkpoint = options.get("checkpoint")
        self.at: dict | None = None  # where the next batch starts

    def initialOffset(self) -> dict:
        return {"shard": -1, "row": 0, "idx": 0}

    def _planned(self) -> dict | None:
        """The end of the last batch in the query's log of offsets; the beginning, if there is none."""
        if not self.checkpoint:
            return None
        system, root = open_path(self.checkpoint.rstrip("/"))
        found = system.get_file_info(fs.FileSelector(f"{root}/offsets", allow_not_found=True))
        numbers = sorted(int(x.base_name) for x in found if x.base_name.isdigit())
        if not numbers:
            return self.initialOffset()
        with system.open_input_stream(f"{root}/offsets/{numbers[-1]}") as f:
            for line in f.read().decode().splitlines():
                try:
                    offset = json.loads(line)
                except ValueError:
                    continue
                if isinstance(offset, dict) and offset.keys() == {"shard", "row", "idx"}:
                    return offset
        return None

    def _slices(self, start: dict, most: int | None, end: dict | None = None) -> tuple[list[Slice], dict]:
        """Slices from start on, of at most `most` rows or up to end, and the offset after them."""
        out, shard, row, idx = [], start["shard"], start["row"], start["idx"]
        for number in shard_numbers(self.path, self.name):
            if number < shard or end is not None and number > end["shard"]:
                continue
            if number > shard:
                shard, row = number, 0
            n = count_rows(self.path, self.name, number)
            stop = n if end is None or number < end["shard"] else end["row"]
            stop = stop if most is None else min(stop, row + most)
            out += [Slice(number, i, min(i + self.per_task, stop), idx - row) for i in range(row, stop, self.per_task)]
            most = None if most is None else most - (stop - row)
            idx, row = idx + stop - row, stop
            if most == 0:
                break
        return out, {"shard": shard, "row": row, "idx": idx}

    def latestOffset(self) -> dict:
        start = self.at or self._planned()
        return self._slices(start or self.initialOffset(), self.per_batch if start else None)[1]

    def partitions(self, start: dict, end: dict) -> list[Slices]:
        """Neighbouring slices of `rowsPerTask` rows together: many short shards are few tasks."""
        self.at = end
        out, rows = [Slices([])], 0
        for part in self._slices(start, None, end)[0]:
            n = part.last - part.first
            if rows and rows + n > self.per_task:
                out, rows = [*out, Slices([])], 0
            out[-1].value.append(part)
            rows += n
        return out

    def read(self, parts: Slices) -> Iterator[pa.RecordBatch]:
        for part in parts.value:
            yield from read_rows(self.path, self.name, part.shard, part.base, part.rows)


class Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


def _commit(path: str, messages: list[Written]) -> None:
    system, _ = open_path(path)
    done: set[str] = set()
    for tmp, end in (x for m in messages if m for x in m.files):
        if end in done:
            raise ValueError(f"{end} was written by two tasks: repartition by shard first")
        done.add(end)
        system.move(tmp, end)


class Writer(DataSourceArrowWriter):
    """Rows (shard, local_idx, tokens, and ends_document where a document ends with the sequence); a shard is whole in
    one task and in order there. Null tokens are none. layout=old writes the older index."""

    def __init__(self, options: dict):
        self.path, self.name = options["path"].rstrip("/"), options.get("name", "data")
        vocab = options.get("vocabsize")
        self.code, self.old = int(options.get("code", best_code(int(vocab) if vocab else None))), options.get("layout") == "old"

    def write(self, rows: Iterator[pa.RecordBatch]) -> Written:
        system, root = open_path(self.path)
        system.create_dir(root, recursive=True)
        kind = np.dtype(CODES[self.code]).newbyteorder("<")
        files: list[tuple[str, str]] = []
        shard, sizes, ends, out, seen = None, [], [], None, set()

        def close() -> None:
            if out is None:
                return
            out.close()
            all_ = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            marks = np.concatenate([[0], np.flatnonzero(np.concatenate(ends)) + 1]) if ends and any(e.any() for e in ends) else None
            with system.open_output_stream(files[-1][0]) as f:
                f.write(old_index_bytes([(int(n),) for n in all_], self.code, marks) if self.old else index_bytes(all_, self.code, marks))

        for batch in rows:
            if not batch.num_rows:
                continue
            numbers = batch.column("shard").to_numpy(zero_copy_only=False)
            tokens = batch.column("tokens")
            n = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = pc.list_flatten(tokens).to_numpy(zero_copy_only=False)
            end = pc.fill_null(batch.column("ends_document"), False).to_numpy(zero_copy_only=False) if "ends_document" in batch.schema.names else np.zeros(len(n), bool)
            if len(values) and np.issubdtype(kind, np.integer) and not np.iinfo(kind).min <= values.min() <= values.max() <= np.iinfo(kind).max:
                raise OverflowError(f"a token of shards {numbers.min()} to {numbers.max()} does not fit {kind}")
            data, at = values.astype(kind), np.concatenate([[0], np.cumsum(n)])
            change = np.concatenate([[0], np.flatnonzero(np.diff(numbers)) + 1, [len(n)]])
            for a, b in zip(change[:-1], change[1:], strict=True):
                if numbers[a] != shard:
                    close()
                    shard, sizes, ends = int(numbers[a]), [], []
                    if shard in seen:
                        raise ValueError(f"rows of shard {shard} are not together")
                    seen.add(shard)
                    name, tmp = f"{root}/{self.name}_{shard}", f"{root}/.{self.name}_{shard}-{uuid.uuid4().hex}"
                    files += [(f"{tmp}.bin", f"{name}.bin"), (f"{tmp}.idx", f"{name}.idx")]
                    out = system.open_output_stream(f"{tmp}.bin")
                out.write(data[at[a] : at[b]].tobytes())
                sizes.append(n[a:b])
                ends.append(end[a:b])
        close()
        return Written(files)

    def commit(self, messages: list[Written]) -> None:
        _commit(self.path, messages)

    def abort(self, messages: list[Written]) -> None:
        system, _ = open_path(self.path)
        for tmp, _ in (x for m in messages if m for x in m.files):
            if system.get_file_info(tmp).type != fs.FileType.NotFound:
                system.delete_file(tmp)


class BinIdx(DataSource):
    @classmethod
    def name(cls) -> str:
        return "binidx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return FilteringReader(self.options) if self.options.get("pushdown") == "true" else Reader(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options)


def load(spark: SparkSession, path: str, name: str = "data", **options: int | str) -> DataFrame:
    """idx, shard, local_idx, tokens of the shards below path."""
    spark.dataSource.register(BinIdx)
    return spark.read.format("binidx").options(path=path, name=name, **options).load()


def where(spark: SparkSession, path: str, condition: Column | str, name: str = "data", **options: int | str) -> DataFrame:
    """The rows that condition holds for; what it says of idx, shard and local_idx decides what is read. Spark 4.1 keeps
    one set of pushed conditions for a loaded table, so this is a table of its own for each condition: call it again for
    another one rather than look at the result under several further conditions in one plan."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return load(spark, path, name, pushdown="true", **options).filter(condition)


def save(rows: DataFrame, path: str, name: str = "data", **options: int | str) -> None:
    """Write rows (shard, local_idx, tokens and maybe ends_document), each shard by one task."""
    rows.sparkSession.dataSource.register(BinIdx)
    rows.repartition("shard").sortWithinPartitions("shard", "local_idx").write.format("binidx").options(path=path, name=name, **options).mode("append").save()


def manifest(spark: SparkSession, path: str, name: str = "data") -> DataFrame:
    """shard, n, lo, hi of the shards below path; the heads of their indexes are read in tasks."""
    numbers = spark.createDataFrame([(n,) for n in shard_numbers(path, name)], "shard int")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [count_rows(path, name, s) for s in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["shard", "n"])

    return sequences.offsets(numbers.mapInArrow(count, "shard int, n long"))


def fetch(ids: DataFrame, path: str, name: str = "data", block: int = 1 << 16, gap: int = 1 << 16) -> DataFrame:
    """idx, shard, local_idx, tokens of the stored sequences with the numbers in ids (idx), each once; numbers beyond the
    last row have none, nor has null. Rows that are asked for are dealt by shard and block of rows, so a task reads
    neighbours together, and of a shard nothing that is not asked for but gaps of at most `gap` bytes."""
    spark = ids.sparkSession
    shards = manifest(spark, path, name)
    asked = sequences.locate(ids.select("idx").filter("idx is not null").distinct(), shards)
    dealt = asked.select("shard", "local_idx", (F.col("idx") - F.col("local_idx")).alias("base")).repartition("shard", F.floor(F.col("local_idx") / block)).sortWithinPartitions("shard", "local_idx")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, local, base = (c.to_numpy() for c in batch.columns)
            change = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]]) if len(shard) else []
            for a, b in zip(change[:-1], change[1:], strict=True):
                yield from read_rows(path, name, int(shard[a]), int(base[a]), local[a:b], gap)

    return dealt.mapInArrow(read, SCHEMA)


def merge(spark: SparkSession, sources: list[tuple[str, str]], path: str, name: str = "data", per_shard: int = 1) -> None:
    """Join stored shards (path, name) in their order, `per_shard` of them into each new one: bytes are copied as they are,
    places and document marks move by what lies before. Nothing is decoded. Shards of one new shard have one type."""
    old = [(p, n, s) for p, n in sources for s in shard_numbers(p, n)]
    groups = [old[i : i + per_shard] for i in range(0, len(old), per_shard)]
    if not groups:
        return
    frame = spark.createDataFrame([(i, [list(map(str, x)) for x in g]) for i, g in enumerate(groups)], "shard int, parts array<array<string>>").repartition(len(groups))

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_path(path)
        system.create_dir(root, recursive=True)
        for batch in batches:
            names = []
            for shard, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tmp, sizes, marks, code, before = f"{root}/.{name}_{shard}-{uuid.uuid4().hex}", [], [np.zeros(1, np.int64)], None, 0
                with system.open_output_stream(f"{tmp}.bin") as out:
                    for p, n, s in parts:
                        index = read_index(p, n, int(s))
                        if code not in (None, index.code):
                            raise ValueError(f"shard {s} of {p} has type {index.code}, not {code}")
                        code = index.code
                        other, folder = open_path(p)
                        with other.open_input_stream(f"{folder}/{n}_{s}.bin") as f:
                            while data := f.read(8 << 20):
                                out.write(data)
                        sizes.append(index.sizes)
                        marks.append(index.documents[index.documents > 0] + before)
                        before += len(index.sizes)
                with system.open_output_stream(f"{tmp}.idx") as f:
                    f.write(index_bytes(np.concatenate(sizes), code, np.concatenate(marks)))
                names += [(f"{tmp}{x}", f"{root}/{name}_{shard}{x}") for x in (".bin", ".idx")]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in names]) for c in (0, 1)], ["tmp", "end"])

    # a task that runs again writes under other names; only what the finished ones name becomes a shard
    done = frame.mapInArrow(copy, "tmp string, end string").collect()  # two names a new shard
    _commit(path, [Written([(r.tmp, r.end) for r in done])])
