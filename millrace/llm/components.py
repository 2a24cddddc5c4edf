"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.store import Table


def _to_least(both: DataFrame) -> DataFrame:
    """u, v, m: each directed edge with the least of u and its neighbours, which is aggregated map-side and joined back."""
    least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
    return both.join(least, "u")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (least node of its component) for every node of edges (a, b: long), by alternating large and
    small stars. Each round is written to the shared folder; the number of rounds grows with the logarithm of the
    longest chain. Self loops and repeated edges are allowed; no edges give no rows."""
    table = Table(edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).filter("u != v").distinct())
    state = None
    for _ in range(rounds):
        now, last = table.rows, table
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        small = _to_least(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        table = Table(small)
        last.remove()
        seen = table.rows.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if seen == state or not seen[0]:
            break
        state = seen
    else:
        raise RuntimeError("components did not settle")
    now = table.rows
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
