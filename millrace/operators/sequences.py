"""Sequence tables: shards, manifests, lookup by global row number, ranges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.order import row_number, seeded


def into_shards(rows: DataFrame, order: list[str], per_shard: int = 1_000_000, first: int = 0, shuffle_seed: int | None = None) -> DataFrame:
    """rows with idx (global, from 0), shard and local_idx; a shard is full before the next begins. shuffle_seed: rows
    change places within their shard, and idx with them."""
    out = row_number(rows, order, "idx").withColumn("shard", (F.floor(F.col("idx") / per_shard) + first).cast("int"))
    if shuffle_seed is None:
        return out.withColumn("local_idx", (F.col("idx") % per_shard).cast("int"))
    place = F.row_number().over(Window.partitionBy("shard").orderBy(seeded("idx", seed=shuffle_seed), "idx")) - 1
    return out.withColumn("local_idx", place.cast("int")).withColumn("idx", (F.col("shard") - first) * F.lit(per_shard).cast("long") + F.col("local_idx"))


def manifest(rows: DataFrame) -> DataFrame:
    """shard, n, lo, hi: how many rows each shard has, and which global rows; shards after a gap in the numbering are
    left out. One row a shard."""
    return offsets(rows.groupBy("shard").agg(F.count("*").alias("n")))


def offsets(sizes: DataFrame) -> DataFrame:
    """The same from shard and n; there are few shards beside their rows."""
    order = Window.orderBy("shard")
    lo = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    unbroken = F.col("shard") - F.row_number().over(order) == F.min("shard").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - 1
    return sizes.withColumns({"lo": lo, "_ok": unbroken}).filter("_ok").withColumn("hi", F.col("lo") + F.col("n")).drop("_ok")


def locate(ids: DataFrame, shards: DataFrame, per_shard: int | None = None) -> DataFrame:
    """ids (idx) with shard and local_idx. With equal shard sizes the shard is arithmetic; else it is a range join, made
    an equality one by cutting each shard's range into strips as wide as the mean shard: there are at most two strips a
    shard on average, however uneven the shards are."""
    if per_shard:
        return ids.withColumns({"shard": F.floor(F.col("idx") / per_shard).cast("int"), "local_idx": (F.col("idx") % per_shard).cast("long")})
    total, count = shards.agg(F.sum("n"), F.count("*")).first()
    width = max(1, -(-int(total or 0) // max(1, count)))
    shards = shards.filter("n > 0")
    strips = shards.withColumn("_strip", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    asked = ids.withColumn("_strip", F.floor(F.col("idx") / width))
    return asked.join(strips, "_strip").filter("lo <= idx and idx < hi").withColumn("local_idx", F.col("idx") - F.col("lo")).drop("_strip", "lo", "hi", "n")


def between(rows: DataFrame, low: int = 0, high: int | None = None) -> DataFrame:
    """Rows low <= idx < high, counted from low."""
    kept = rows.filter(F.col("idx") >= low) if high is None else rows.filter((F.col("idx") >= low) & (F.col("idx") < high))
    return kept.withColumn("idx", F.col("idx") - low)


def between_ratios(rows: DataFrame, low: float, high: float) -> DataFrame:
    """Rows from int(low * n) to int(high * n)."""
    n = rows.count()
    return between(rows, int(low * n), int(high * n))


def by_role(load: Callable[[Column], DataFrame], n: int, shares: tuple[tuple[str, int], ...] = (("train", 80), ("dev", 10), ("test", 10)), most: int | None = None) -> dict[str, DataFrame]:
    """The rows (idx) of each role: stretches of so many hundredths of n rows, in this order. most: no more rows a role;
    a role that has fewer than that is an error. load gives the rows for a condition on idx; a source that takes conditions
    reads that range alone."""
    out, before = {}, 0
    for role, share in shares:
        low, high = n * before // 100, n * (before + share) // 100
        if most is not None:
            if high - low < most:
                raise ValueError(f"{role} has {high - low} rows, fewer than {most}")
            high = low + most
        out[role] = load((F.col("idx") >= low) & (F.col("idx") < high))
        before += share
    return out


def part_of_row(tokens: Column, offset: int, length: int | None = None) -> Column:
    return F.slice(tokens, F.lit(offset + 1), F.lit(length) if length is not None else F.greatest(F.size(tokens) - offset, F.lit(0)))


def hold_out(rows: DataFrame, first: int, last: int) -> DataFrame:
    """The shards from first to last, numbered from 0."""
    return rows.filter(F.col("shard").between(first, last)).withColumn("shard", F.col("shard") - first)


def length_stats(rows: DataFrame, tokens: str = "tokens") -> DataFrame:
    return rows.agg(F.max(F.size(tokens)).alias("longest"), F.min(F.size(tokens)).alias("shortest"), F.avg(F.size(tokens)).alias("mean"))
