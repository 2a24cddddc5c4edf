"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Sources share all words of the input by weight, none above `most` times its own size (water filling). The shares
become whole blocks of equal size: seats go one by one to the highest quotient target / (2 k + 1), and every M
seats in that order are one output shard, which gives each shard an integer quota per source. A source's
documents lie in a seeded order; its blocks are consecutive stretches of words of that order, and each shard takes
the next ones that its quota allows, from the start again once all are used.

Only one row per source (its words) reaches the driver. Documents are placed by prefix sums over (source, range of
the seeded hash), so a source with a third of all rows is spread over as many tasks as its size asks for.
"""

from __future__ import annotations

import heapq
import itertools
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.store import hold, release

NEW = ("size", "source_size", "target", "taken", "cycles", "part", "start", "edges")
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[int], most: int = 3) -> list[Fraction]:
    """Exact shares of sum(sizes) by weight, none above most times its size, the excess reshared by weight."""
    out: list[Fraction] = [Fraction(0)] * len(sizes)
    free, rest = set(range(len(sizes))), Fraction(sum(sizes))
    while free:
        total = sum(weights[i] for i in free)
        above = {i for i in free if rest * weights[i] > total * most * sizes[i]}
        if not above:
            for i in free:
                out[i] = rest * weights[i] / total
            break
        for i in above:
            out[i] = Fraction(most * sizes[i])
            rest -= out[i]
        free -= above
    return out


def apportion(shares: list[Fraction], seats: int, caps: list[int]) -> list[int]:
    """Sainte-Laguë: whole seats by highest quotients share / (2 k + 1), ties to the earlier source, at most caps.

    All seats whose quotient is above a threshold that surely leaves some over are given at once, the last few by
    a heap, so the work does not depend on the number of seats."""
    live = {i for i, s in enumerate(shares) if s > 0 and caps[i] > 0}
    seats = min(seats, sum(caps[i] for i in live))
    got = [0] * len(shares)
    free = set(live)
    while free:
        room = seats - len(live) - sum(caps[i] for i in live - free)
        rate = max(Fraction(0), Fraction(room) / sum(shares[i] for i in free))
        full = {i for i in free if int(shares[i] * rate + Fraction(1, 2)) >= caps[i]}
        if not full:
            break
        free -= full
    for i in live:
        got[i] = caps[i] if i not in free else int(shares[i] * rate + Fraction(1, 2))
    heap = [(-shares[i] / (2 * got[i] + 1), i) for i in live if got[i] < caps[i]]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-shares[i] / (2 * got[i] + 1), i))
    return got


def plan(sizes: list[int], weights: list[int], most: int = 3, shards: int = 16, fineness: int = 400) -> dict:
    """Block length, targets and, per source, quotas by shard. The length is such that the smallest positive target
    has some `fineness` blocks, so rounding to blocks moves no source by more than a part in that many."""
    share = targets(sizes, weights, most)
    least = min((s for s in share if s > 0), default=Fraction(1))
    block = max(1, int(least / fineness))
    caps = [most * -(-n // block) for n in sizes]
    seats = round(sum(share) / block)
    edges = [apportion(share, seats * s // shards, caps) for s in range(shards + 1)]
    quotas = [[edges[s + 1][i] - edges[s][i] for s in range(shards)] for i in range(len(sizes))]
    return {"block": block, "targets": share, "quotas": quotas}


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 42, shards: int = 16, rows_per_bucket: int = 4_000) -> DataFrame:
    """docs with size, source_size, target, taken, cycles (whole copies taken), part (words of one further, partial
    copy), start (words before it in its source's order) and edges (words at which each shard of the source ends, on and
    on through its copies, 0 first). docs needs doc_id, text, source.

    Null text has size 0; null source is a source of its own, last in order; repeated rows count each by itself;
    documents without words are in no block (taken 0); a very long text is cut by blocks as any other; ties of the
    seeded order go by doc_id; a column of docs with the name of a new one is replaced. An empty table gives an empty
    table.
    """
    spark = docs.sparkSession
    sized = hold(docs, "doc_id", "text", "source").withColumns({"size": n_words(F.col("text")), "_order": F.xxhash64(F.lit(seed), "doc_id", "text")})
    totals = [(r[0], int(r[1] or 0), int(r[2])) for r in sized.groupBy("source").agg(F.sum("size"), F.count("*")).collect()]
    totals.sort(key=lambda r: (r[0] is None, (r[0] or "").encode("utf-32-be")))
    p = plan([r[1] for r in totals], [weights[i % len(weights)] for i in range(len(totals))], most, shards)
    buckets = max(1, -(-max((r[2] for r in totals), default=1) // rows_per_bucket))
    rows = []
    for (source, size, _), target, quota in zip(totals, p["targets"], p["quotas"], strict=True):
        n = -(-size // p["block"])
        cycles, rest = divmod(sum(quota), n) if n else (0, 0)
        ends = [0]
        for q in itertools.accumulate(quota):
            round_, within = divmod(q, n) if n else (0, 0)
            ends.append(int(round_ * size + min(within * p["block"], size)))
        rows.append((source, size, float(target), int(cycles), int(min(rest * p["block"], size)), ends))
    sources = spark.createDataFrame(rows, "_source string, source_size long, target double, _cycles long, _left long, edges array<long>")

    # A bucket is a range of the seeded hash, so a source's buckets in order hold its documents in order.
    key = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source"))
    bucket = F.least(F.lit(buckets - 1), F.floor((F.col("_order").cast("double") / F.lit(2.0**64) + 0.5) * buckets)).cast("long")
    placed = sized.withColumns({"_key": key, "_bucket": bucket})
    before = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_key", "_bucket").agg(F.sum("size").alias("_in")).withColumn("_base", F.coalesce(F.sum("_in").over(before), F.lit(0))).drop("_in").join(sources.withColumn("_key", F.when(F.col("_source").isNull(), "").otherwise(F.concat(F.lit("="), "_source"))).drop("_source"), "_key")
    inside = Window.partitionBy("_key", "_bucket").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["_key", "_bucket"])
    start = (F.col("_base") + F.col("_inside")).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("_left") - start, F.col("size")))
    out = out.withColumns({"cycles": F.col("_cycles"), "part": part.cast("long"), "start": start}).withColumn("taken", (F.col("cycles") * F.col("size") + F.col("part")).cast("long"))
    return release(out, docs.columns, *NEW)


def stretches(mixed: DataFrame) -> DataFrame:
    """The blocks of the mix shard by shard: doc_id, source, shard, copy, first (words of the copy before it), n_words of
    each stretch that a shard takes of a copy. A shard's words of a source are those of its whole blocks."""
    whole = F.when(F.col("copy") < F.col("cycles"), F.col("size")).otherwise(F.col("part"))
    copies = mixed.filter("size > 0").select("doc_id", "source", "size", "source_size", "cycles", "part", "start", "edges", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cycles"))).alias("copy"))
    copies = copies.withColumn("lo", F.col("copy") * F.col("source_size") + F.col("start")).withColumn("hi", F.col("lo") + whole)
    cuts = F.transform(F.slice("edges", F.lit(2), F.size("edges") - 1), lambda e, s: F.struct(s.alias("shard"), F.greatest("lo", F.get("edges", s)).alias("a"), F.least(F.col("hi"), e).alias("b")))
    out = copies.select("doc_id", "source", "copy", "lo", F.explode(F.filter(cuts, lambda c: c["b"] > c["a"])).alias("cut"))
    return out.select("doc_id", "source", "cut.shard", "copy", (F.col("cut.a") - F.col("lo")).alias("first"), (F.col("cut.b") - F.col("cut.a")).alias("n_words"))


def emit(mixed: DataFrame) -> DataFrame:
    """The rows of the mix: a row for each whole copy and, at the end of a source's stretch, the taken words of one
    more copy (with the blanks before them), so that words per source are those of the plan. n_chars, if there is one,
    follows the text."""
    cols = [c for c in mixed.columns if c not in NEW]
    held = hold(mixed, "text", *NEW)
    whole = (F.col("cycles") + F.when(F.col("part") == F.col("size"), 1).otherwise(0)).cast("int")
    words = F.regexp_extract_all(F.col("text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.array_join(F.slice(words, F.lit(1), F.col("part").cast("int")), "")
    texts = F.when((F.col("part") > 0) & (F.col("part") < F.col("size")), F.concat(F.array_repeat(F.col("text"), whole), F.array(cut))).otherwise(F.array_repeat(F.col("text"), whole))
    out = held.filter(F.col("size") > 0).select("*", F.explode(texts).alias("_text")).withColumn("text", F.col("_text"))
    out = release(out, cols)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in cols else out
