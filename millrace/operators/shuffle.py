"""Seeded permutations of row numbers by arithmetic: neither a sort nor a table of the order is needed.

A row number below n is written as (left, right) with left < a and right < b, a * b the least such product of about equal
parts that is n or more. Rounds add a function of one half to the other, modulo its range, which is undone by subtraction,
so they are a bijection of [0, a * b); numbers that leave [0, n) go through the rounds again until they are back in it.
The arithmetic runs on Arrow batches; n may be up to 2**60.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 6
_PRIME = 2147483647


def sides(n: int) -> tuple[int, int]:
    """a and b, both below 2**31: fewer than a numbers are beyond n, so few have to go round again."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def _mixed(value: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A number below 2**31 - 1 that depends on both; products stay below 2**62."""
    x = (value * 1103515245 + key) % _PRIME
    x = ((x ^ (x >> 15)) * 48271) % _PRIME
    return ((x ^ (x >> 13)) * 69621) % _PRIME


def permuted(x: np.ndarray, n: int, seed: int, epoch: np.ndarray, back: bool = False) -> np.ndarray:
    """Where each of the numbers x, all in [0, n), goes in its epoch's order, or with back, which number is there."""
    a, b = sides(n)
    x, key = x.astype(np.int64), (seed * 1000003 + epoch.astype(np.int64) * 7919) % _PRIME
    out, live = x.copy(), np.arange(len(x))
    while len(live):
        left, right = out[live] // b, out[live] % b
        for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if k % 2 == 0:
                move = _mixed(right, key[live] + k * 104729)
                left = (left - move if back else left + move) % a
            else:
                move = _mixed(left, key[live] + k * 104729)
                right = (right - move if back else right + move) % b
        out[live] = left * b + right
        live = live[out[live] >= n]
    return out


def _column(x: Column, n: int, seed: int, epoch: Column, back: bool) -> Column:
    @F.pandas_udf("long")
    def run(x: pd.Series, epoch: pd.Series) -> pd.Series:
        good = (x.notna() & epoch.notna() & (x >= 0) & (x < n)).to_numpy()
        out = np.full(len(x), -1, np.int64)
        out[good] = permuted(x.to_numpy()[good].astype(np.int64), n, seed, epoch.to_numpy()[good].astype(np.int64), back)
        return pd.Series(out)

    there = run(x.cast("long"), epoch.cast("long"))
    return F.when(there >= 0, there)


def place_of(idx: Column, n: int, seed: int, epoch: Column) -> Column:
    """Where row idx of n stands in an epoch's order; null outside of [0, n)."""
    return _column(idx, n, seed, epoch, False)


def row_at(pos: Column, n: int, seed: int, epoch: Column) -> Column:
    """Which of n rows stands at a place of an epoch's order; null outside of [0, n)."""
    return _column(pos, n, seed, epoch, True)


def in_epochs(rows: DataFrame, n: int, epochs: int, seed: int = 1234) -> DataFrame:
    """epoch, pos and the columns of rows (idx: 0 to n - 1, each once), which is read once for all epochs."""
    each = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    return each.withColumn("pos", place_of(F.col("idx"), n, seed, F.col("epoch")))


def rows_from(spark: SparkSession, n: int, epochs: int, epoch: int, pos: int, seed: int = 1234) -> DataFrame:
    """epoch, pos, idx of an order of n rows from (epoch, pos) on: what a training run that stopped there has yet to see.
    Made from the numbers of the places alone; no earlier place is computed and nothing is sorted."""
    places = spark.range(min(epoch * n + pos, epochs * n), epochs * n)
    split = places.select(F.expr(f"cast(id div {max(1, n)} as int)").alias("epoch"), (F.col("id") % max(1, n)).alias("pos"))
    return split.withColumn("idx", row_at(F.col("pos"), n, seed, F.col("epoch")))
