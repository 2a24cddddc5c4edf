"""Stored shards: pushed conditions, point reads, merging, the older layout, streams."""

import json

import numpy as np
import pytest
from pyarrow import fs
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from millrace.operators import sequences
from millrace.plans import catalog
from millrace.sources import binidx
from millrace.streaming import incremental


def stored(spark, path, sizes=(500, 500, 1), **options):
    """Shards of so many rows; row i has the tokens i, i + 1, ... (i % 5 of them)."""
    rows, base = [], 0
    for shard, n in enumerate(sizes):
        rows += [(shard, i, list(range(base + i, base + i + (base + i) % 5))) for i in range(n)]
        base += n
    binidx.save(spark.createDataFrame(rows, "shard int, local_idx int, tokens array<long>"), str(path), **options)
    return base


class Counted:
    """An open file that notes what is read of it."""

    def __init__(self, f, reads):
        self.f, self.reads = f, reads

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.f.close()

    def read_at(self, n, at):
        self.reads.append((at, n))
        return self.f.read_at(n, at)


class Counting:
    def __init__(self):
        self.reads, self.system = {}, fs.LocalFileSystem()

    def open_input_file(self, path):
        return Counted(self.system.open_input_file(path), self.reads.setdefault(path.rsplit("/", 1)[1], []))

    def __getattr__(self, name):
        return getattr(self.system, name)


def test_pushed_conditions_choose_bytes(spark, tmp_path, monkeypatch):
    stored(spark, tmp_path)
    counting = Counting()
    monkeypatch.setattr(binidx, "open_path", lambda path: (counting, path))
    reader = binidx.FilteringReader({"path": str(tmp_path), "gapBytes": "0"})
    other = ds.GreaterThan(("tokens",), 3)
    assert list(reader.pushFilters([ds.IsNotNull(("idx",)), ds.In(("idx",), (507, 4, 9, 2000, None)), other, ds.LessThan(("shard",), 2)])) == [other]
    parts = reader.partitions()
    assert [(p.shard, p.rows.tolist(), p.base) for p in parts] == [(0, [4, 9], 0), (1, [7], 500)]
    got = [(r["idx"], r["shard"], r["local_idx"], r["tokens"]) for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert got == [(4, 0, 4, [4, 5, 6, 7]), (9, 0, 9, [9, 10, 11, 12]), (507, 1, 7, [507, 508])]
    assert {name: sum(n for _, n in reads) for name, reads in counting.reads.items()} == {"data_0.bin": 32, "data_0.idx": 34 + 24, "data_1.bin": 8, "data_1.idx": 34 + 12}
    assert not list(binidx.FilteringReader({"path": str(tmp_path)}).pushFilters([]))


@pytest.mark.parametrize("condition", [
    "idx in (3, 499, 500, 1000, 5000)", "idx = 1000", "idx >= 498 and idx < 503", "shard = 1 and local_idx < 3", "local_idx = 0", "local_idx in (0, 7) and idx > 400", "shard in (0, 2) and idx between 490 and 2000",
    "idx < 0", "idx = 3 or shard = 2", "size(tokens) = 4 and idx < 20", "shard <=> 2", "not shard = 0",
])
def test_conditions_change_no_result(spark, tmp_path, condition):
    stored(spark, tmp_path)
    whole, some = binidx.load(spark, str(tmp_path)), binidx.where(spark, str(tmp_path), condition, rowsPerTask=100, gapBytes=8)
    want = sorted(whole.filter(condition).collect())
    assert sorted(some.collect()) == want and sorted(some.union(binidx.where(spark, str(tmp_path), "idx = 7")).collect()) == sorted([*want, *whole.filter("idx = 7").collect()])
    assert some.filter("idx % 2 = 0").count() == sum(r.idx % 2 == 0 for r in want) and whole.count() == 1001


def test_fetch_by_a_table_of_ids(spark, tmp_path):
    n = stored(spark, tmp_path)
    ids = [0, 4, 499, 500, 999, 1000, 1000, None, 1001, -3, *range(100, 300, 7)]
    frame = spark.createDataFrame([(i,) for i in ids], "idx long")
    got = sorted(map(tuple, binidx.fetch(frame, str(tmp_path), block=50, gap=0).collect()))
    assert got == [(i, i // 500, i % 500, list(range(i, i + i % 5))) for i in sorted({i for i in ids if i is not None and 0 <= i < n})]
    assert binidx.fetch(frame.limit(0), str(tmp_path)).count() == 0


@pytest.mark.parametrize("sizes", [(500, 500, 1), (1,), (3, 1, 700, 2, 2, 90)])
def test_locate_in_uneven_shards(spark, sizes):
    """A manifest explodes to two strips a shard on average, not to one for each row."""
    rows = [(s,) for s, n in enumerate(sizes) for _ in range(n)]
    shards = sequences.manifest(spark.createDataFrame(rows, "shard int"))
    ids = spark.range(len(rows) + 5).withColumnRenamed("id", "idx")
    located = sequences.locate(ids, shards)
    want = [(s, i) for s, n in enumerate(sizes) for i in range(n)]
    assert [(r.shard, r.local_idx) for r in located.orderBy("idx").collect()] == want
    width = -(-len(rows) // len(sizes))
    assert sum((hi - 1) // width - lo // width + 1 for lo, hi in ((r.lo, r.hi) for r in shards.collect())) <= 2 * len(sizes)


def test_merge_keeps_bytes_and_documents(spark, tmp_path):
    rows = [(i // 4, i % 4, list(range(i)), i % 3 == 2) for i in range(14)]
    frame = spark.createDataFrame(rows, "shard int, local_idx int, tokens array<long>, ends_document boolean")
    binidx.save(frame, str(tmp_path / "a"))
    binidx.save(frame.filter("shard < 2"), str(tmp_path / "b"), name="other", layout="old")
    assert [binidx.read_index(str(tmp_path / "a"), "data", s).documents.tolist() for s in range(4)] == [[0, 3], [0, 2], [0, 1, 4], [0]]
    binidx.merge(spark, [(str(tmp_path / "a"), "data"), (str(tmp_path / "b"), "other")], str(tmp_path / "c"), "joined", per_shard=6)
    index = binidx.read_index(str(tmp_path / "c"), "joined", 0)
    assert index.documents.tolist() == [0, 3, 6, 9, 12, 17, 20] and len(index.sizes) == 22
    back = binidx.load(spark, str(tmp_path / "c"), "joined").orderBy("idx").collect()
    assert [r.tokens for r in back] == [list(range(i)) for i in [*range(14), *range(8)]]
    assert (tmp_path / "c" / "joined_0.bin").read_bytes() == b"".join((tmp_path / d / f"{n}_{s}.bin").read_bytes() for d, n, k in (("a", "data", 4), ("b", "other", 2)) for s in range(k))
    assert sorted(p.name for p in (tmp_path / "c").iterdir()) == ["joined_0.bin", "joined_0.idx"]
    binidx.save(frame.filter("shard = 0"), str(tmp_path / "d"), code=8)
    with pytest.raises(Exception, match="has type 8, not 4"):
        binidx.merge(spark, [(str(tmp_path / "a"), "data"), (str(tmp_path / "d"), "data")], str(tmp_path / "e"), per_shard=9)


def test_older_layout_and_items_of_several_dimensions(spark, tmp_path):
    n = stored(spark, tmp_path / "old", (7, 3), layout="old")
    assert (tmp_path / "old" / "data_0.idx").read_bytes().startswith(binidx.OLD_MAGIC)
    assert [r.tokens for r in binidx.load(spark, str(tmp_path / "old")).orderBy("idx").collect()] == [list(range(i, i + i % 5)) for i in range(n)]
    shapes = [(2, 3), (4,), (), (0, 2), (2, 1, 2)]
    (tmp_path / "nd").mkdir()
    (tmp_path / "nd" / "data_0.idx").write_bytes(binidx.old_index_bytes(shapes, 4))
    (tmp_path / "nd" / "data_0.bin").write_bytes(np.arange(15, dtype="<i4").tobytes())
    got = binidx.load(spark, str(tmp_path / "nd"))
    assert [r.tokens for r in got.orderBy("idx").collect()] == [[0, 1, 2, 3, 4, 5], [6, 7, 8, 9], [10], [], [11, 12, 13, 14]]
    assert binidx.where(spark, str(tmp_path / "nd"), "idx = 1").first().tokens == [6, 7, 8, 9]


def test_writer_refuses_what_does_not_fit(spark, tmp_path):
    rows = spark.createDataFrame([(0, 0, [70000])], "shard int, local_idx int, tokens array<long>")
    with pytest.raises(Exception, match="does not fit"):
        binidx.save(rows, str(tmp_path / "x"), vocabsize=100)
    apart = spark.createDataFrame([(0, 0, [1]), (1, 0, [1]), (0, 1, None)], "shard int, local_idx int, tokens array<long>").coalesce(1)
    spark.dataSource.register(binidx.BinIdx)
    with pytest.raises(Exception, match="not together"):
        apart.write.format("binidx").option("path", str(tmp_path / "y")).mode("append").save()
    binidx.save(apart, str(tmp_path / "z"))
    assert [r.tokens for r in binidx.load(spark, str(tmp_path / "z")).orderBy("idx").collect()] == [[1], [], [1]]


def test_roles_have_their_rows_and_no_more(spark):
    rows = spark.range(101).withColumnRenamed("id", "idx").filter
    got = {role: [r.idx for r in part.orderBy("idx").collect()] for role, part in sequences.by_role(rows, 101).items()}
    assert got == {"train": list(range(80)), "dev": list(range(80, 90)), "test": list(range(90, 101))}
    assert {role: part.count() for role, part in sequences.by_role(rows, 101, most=10).items()} == {"train": 10, "dev": 10, "test": 10}
    with pytest.raises(ValueError, match="dev has 10 rows, fewer than 11"):
        sequences.by_role(rows, 101, most=11)


def test_a_stopped_stream_of_shards_goes_on(spark, tmp_path):
    path, out, mark = (str(tmp_path / x) for x in ("shards", "out", "mark"))
    stored(spark, path, (40, 25))
    query = spark.readStream.format("binidx").options(path=path, rowsPerBatch=7, checkpoint=mark).load().writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).start()
    for _ in range(120):
        if query.awaitTermination(1) or any((tmp_path / "mark" / "commits").glob("1")):
            break
    query.stop()
    begun = spark.read.schema(binidx.SCHEMA).parquet(out).count()
    assert begun and begun % 7 in (0, 65 % 7)
    incremental.shards_to_table(spark, path, out, mark, per_batch=7)
    more = spark.createDataFrame([(2, i, [i]) for i in range(5)], "shard int, local_idx int, tokens array<long>")
    binidx.save(more, path)
    incremental.shards_to_table(spark, path, out, mark, per_batch=3)
    rows = spark.read.schema(binidx.SCHEMA).parquet(out).orderBy("idx").collect()
    assert [(r.idx, r.shard, r.local_idx) for r in rows] == [*((i, i // 40, i % 40) for i in range(65)), *((65 + i, 2, i) for i in range(5))]
    assert [r.tokens for r in rows[:3]] == [[], [1], [2, 3]]
    ends = [json.loads((tmp_path / "mark" / "offsets" / str(n)).read_text().splitlines()[-1])["idx"] for n in range(len(list((tmp_path / "mark" / "offsets").glob("[0-9]*"))))]
    assert max(b - a for a, b in zip([0, *ends], ends, strict=False)) <= 7 and ends[-1] == 70
    assert spark.read.schema(binidx.SCHEMA).parquet(out).agg(F.count_distinct("idx")).first()[0] == 70


def test_many_short_shards_are_few_tasks_of_a_stream(spark, tmp_path):
    stored(spark, tmp_path / "s", (3, 4, 2, 9, 1))
    reader = binidx.StreamReader({"path": str(tmp_path / "s"), "rowsPerTask": "7"})
    end = {"shard": 4, "row": 1, "idx": 19}
    parts = reader.partitions(reader.initialOffset(), end)
    assert [[(s.shard, s.first, s.last) for s in p.value] for p in parts] == [[(0, 0, 3), (1, 0, 4)], [(2, 0, 2)], [(3, 0, 7)], [(3, 7, 9), (4, 0, 1)]]
    assert [i for p in parts for batch in reader.read(p) for i in batch.column(0).to_pylist()] == list(range(19))
    assert list(reader.read(reader.partitions(end, end)[0])) == []


def test_micro_batches_do_not_grow_in_number_with_the_table(spark, sf_dir, monkeypatch):
    sizes = []
    run = incremental.shards_to_table
    monkeypatch.setattr(catalog, "SHARD", 5)
    monkeypatch.setattr(incremental, "shards_to_table", lambda *a, per_batch: (sizes.append(per_batch), run(*a, per_batch=per_batch)))
    rows = catalog.QUERIES["streamed_shards"](spark, sf_dir)
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert sizes == [-(-n // 16)] and sizes[0] > 10
    assert sorted(r.idx for r in rows.select("idx").collect()) == list(range(n))
