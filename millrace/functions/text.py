"""Text and array functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[a-z0-9]+|[^a-z0-9\s]"


def tokenize(text: Column) -> Column:
    """Lower-cased runs of letters and digits, and other visible characters one by one."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def newlines(text: Column) -> Column:
    """The <n> marker of prompt files as a line break."""
    return F.replace(text, F.lit("<n>"), F.lit("\n"))


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")


def trailing_number(name: Column) -> Column:
    """The number after the last underscore of a file name, 0 if there is none."""
    return F.coalesce(F.element_at(F.split(F.regexp_replace(name, r"\.[a-z]+$", ""), "_"), -1).try_cast("int"), F.lit(0))


def pad(values: Column, size: int, fill: Column, left: bool = False) -> Column:
    """An array filled up to size, or as it is if longer."""
    more = F.array_repeat(fill, F.greatest(F.lit(0), F.lit(size) - F.size(values)).cast("int"))
    return F.concat(more, values) if left else F.concat(values, more)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often use names it; in a lambda it would be once for each element."""
    return F.transform(F.array(value), use)[0]


def trim_pads(values: Column, fill: int) -> Column:
    """Without trailing fill; an array of nothing else stays."""
    last = F.array_max(F.filter(F.transform(values, lambda x, i: F.when(x != fill, i + 1)), lambda x: x.isNotNull()))
    return _once(last, lambda n: F.when(n.isNull(), values).otherwise(F.slice(values, F.lit(1), n)))


def split_array(values: Column, mark: int) -> Column:
    """Sub-arrays between marks, with what follows the last one, empty or not; null of null."""
    at = F.filter(F.transform(values, lambda x, i: F.when(x == mark, i)), lambda x: x.isNotNull())
    edges = F.concat(F.array(F.lit(-1)), at, F.array(F.size(values)))
    return _once(edges, lambda e: F.transform(F.sequence(F.lit(0), F.size(e) - 2), lambda i: F.slice(values, F.get(e, i) + 2, F.get(e, i + 1) - F.get(e, i) - 1)))


def softmax(x: Column, temperature: float = 1.0) -> Column:
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp((v.cast("double") - top) / F.lit(temperature)))
    summed = F.transform(F.array(e), lambda a: F.struct(a.alias("e"), F.aggregate(a, F.lit(0.0), lambda s, y: s + y).alias("z")))
    return F.transform(summed, lambda p: F.transform(p["e"], lambda v: v / p["z"]))[0]


def log_softmax(x: Column) -> Column:
    top = F.array_max(x).cast("double")
    total = F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp(v.cast("double") - top))
    return F.transform(F.array(top + F.ln(total)), lambda z: F.transform(x, lambda v: v.cast("double") - z))[0]


def finite_or_zero(x: Column) -> Column:
    return F.when(F.abs(x) == float("inf"), 0.0).otherwise(x)


def numerize(x: Column) -> Column:
    """1000 as 1K, 1000000 as 1M, 1000000000 as 1B."""
    return F.when(x % 10**9 == 0, F.concat((x / 10**9).cast("long").cast("string"), F.lit("B"))).when(x % 10**6 == 0, F.concat((x / 10**6).cast("long").cast("string"), F.lit("M"))).when(x % 1000 == 0, F.concat((x / 1000).cast("long").cast("string"), F.lit("K"))).otherwise(x.cast("string"))
