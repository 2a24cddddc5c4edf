"""Global order without a single task: prefix sums and row numbers over ranges of the order key."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def new_path(spark: SparkSession, name: str = "stored") -> str:
    """A path that is not in use, in the shared folder of spark.checkpoint.dir. Where that is unset, a local session
    (tests) gets a temporary one; on a cluster that is an error."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="millrace-"))
    return f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, so that what follows does not compute it again."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def seeded(*cols: Column | str, seed: int = 42) -> Column:
    """A key whose order is a permutation that depends on the seed and the values alone, not on partitions."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols)))


def _range_of(key: Column, bounds: list) -> Column:
    """How many ascending bounds are at most key; by blocks, so a row looks at few of them."""
    if len(bounds) <= 64:
        return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= key)) if bounds else F.lit(0)
    blocks = [bounds[i : i + 64] for i in range(0, len(bounds), 64)]
    at = F.greatest(F.lit(0), _range_of(key, [b[0] for b in blocks]) - 1)
    return at * 64 + F.size(F.filter(F.get(F.array(*(F.array(*map(F.lit, b)) for b in blocks)), at), lambda b: b <= key))


def ranges(df: DataFrame, key: Column, name: str = "_range", n: int | None = None, then: Column | None = None) -> DataFrame:
    """df with the number of a range of key, ascending; ranges hold about equally many rows. Nulls are in range 0.

    A value of key that would fill more than one range has a range of its own, which is cut by `then` (a number) in as many:
    equal keys do not end up in one task."""
    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 50 * n)).first()[0] if n > 1 else None
    bounds = sorted(set(cuts or []))
    # 2r + 1 lies between bounds r and r + 1, 2r is the bound r itself
    above = _range_of(key, bounds)
    place = F.coalesce(2 * above + F.when(key.isin(bounds), 0).otherwise(1), F.lit(0)) if bounds else F.lit(0)
    heavy = [b for b in bounds if cuts.count(b) > 1]
    if then is None or not heavy:
        return df.withColumn(name, place.cast("int"))
    found = df.filter(key.isin(heavy)).groupBy(key.alias("_h")).agg(F.percentile_approx(then, [i / n for i in range(1, n)], 50 * n).alias("_c")).collect()  # n rows of n numbers at most
    part = F.lit(0)
    for r in found:
        k = cuts.count(r._h) + 1
        inner = sorted(set((r._c or [])[round(j * n / k) - 1] for j in range(1, k))) if r._c else []
        part = F.when(key == F.lit(r._h), _range_of(then, inner)).otherwise(part)
    return df.withColumn(name, (place * (n + 1) + F.coalesce(part, F.lit(0))).cast("int"))


def _is_number(df: DataFrame, column: Column) -> bool:
    return isinstance(df.select(column.alias("_x")).schema["_x"].dataType, NumericType)


def prefix_sum(df: DataFrame, value: Column, order: list[Column | str], name: str, by: list[str] | None = None, n: int | None = None) -> DataFrame:
    """df with the sum of value over the rows before, in ascending order, by group.

    The first order column is cut into ranges, a value that many rows share by the second one, if that is a number; a
    window runs inside each (group, range) and the ranges' totals, a small table, are summed apart, so neither one group
    nor one key nor the whole table is ever in one task. The order has to be total for a defined result.
    """
    by = by or []
    key = order[0] if isinstance(order[0], Column) else F.col(order[0])
    keyed = df.withColumns({"_k": key, "_v": value})
    second = None if len(order) < 2 else order[1] if isinstance(order[1], Column) else F.col(order[1])
    keyed = ranges(keyed, F.col("_k"), n=n, then=second if second is not None and _is_number(df, second) else None)
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = keyed.groupBy(*by, "_range").agg(F.sum("_v").alias("_t")).withColumn("_base", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
    inside = Window.partitionBy(*by, "_range").orderBy("_k", *order[1:]).rowsBetween(Window.unboundedPreceding, -1)
    summed = keyed.withColumn("_in", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    # a null group is one like the others
    bases = bases.select(*(F.col(c).alias(f"_prefix_by{i}") for i, c in enumerate(by)), F.col("_range").alias("_prefix_range"), "_base")
    same = F.col("_range") == F.col("_prefix_range")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_prefix_by{i}"))
    return summed.join(bases, same).withColumn(name, F.col("_base") + F.col("_in")).drop("_k", "_v", "_range", "_prefix_range", "_base", "_in", *(f"_prefix_by{i}" for i in range(len(by))))


def row_number(df: DataFrame, order: list[Column | str], name: str = "idx", by: list[str] | None = None, n: int | None = None) -> DataFrame:
    """df with a row number from 0 in ascending order, by group."""
    return prefix_sum(df, F.lit(1).cast("long"), order, name, by, n)
