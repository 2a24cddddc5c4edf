"""Sparse teacher distributions and the losses they serve, in long form (a row for each idx, pos, token_id) or with a
row for each position."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.order import new_path


def top_k(probs: DataFrame, k: int) -> DataFrame:
    """idx, pos, token_id, p, rank of the k likeliest tokens at each position, not renormalised; ties to the lower id."""
    order = Window.partitionBy("idx", "pos").orderBy(F.col("p").desc(), "token_id")
    return probs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k_of_array(p: Column, k: int) -> Column:
    """The same for a dense array: structs (token_id, p), likeliest first."""
    entries = F.transform(p, lambda x, i: F.struct((-x).alias("key"), i.alias("token_id"), x.alias("p")))
    return F.transform(F.slice(F.array_sort(entries), 1, k), lambda e: F.struct(e["token_id"].alias("token_id"), e["p"].alias("p")))


def uniform(n: int, *cols: Column | str, seed: int = 42) -> Column:
    """n numbers in [0, 1) that depend on seed and cols alone: 52 bits of a digest each, exact as doubles."""
    key = F.concat_ws(":", F.lit(str(seed)), *((F.col(c) if isinstance(c, str) else c).cast("string") for c in cols))
    digest = lambda j: F.md5(F.concat_ws(":", key, j.cast("string")))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.conv(F.substring(digest(j), 1, 13), 16, 10).cast("double") / F.lit(2.0**52))


def draw(dense: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """idx, pos, token_id, count: n draws with replacement from each row (idx, pos, p ARRAY<DOUBLE>), by where uniform
    numbers fall in the running sum of p. The draws of a row depend on seed, idx and pos alone, not on partitions or
    retries. A row without probability has no draws."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, u = batch.column(2), batch.column(3)
            at, values = p.offsets.to_numpy(), p.values.to_numpy()
            spots = u.flatten().to_numpy().reshape(len(batch), n)
            tokens, counts = [], []
            for i in range(len(batch)):
                upto = np.cumsum(values[at[i] : at[i + 1]])
                drawn = np.searchsorted(upto, spots[i] * upto[-1], "right") if len(upto) and upto[-1] > 0 else np.zeros(0, np.int64)
                which, times = np.unique(np.minimum(drawn, len(upto) - 1), return_counts=True)
                tokens.append(which)
                counts.append(times)
            row = np.repeat(np.arange(len(batch)), [len(t) for t in tokens])
            flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (tokens, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), *(pa.array(x.astype(np.int32)) for x in flat)], ["idx", "pos", "token_id", "count"])

    rows = dense.filter(F.col("p").isNotNull()).select(F.col("idx").cast("long"), F.col("pos").cast("int"), F.col("p").cast("array<double>"), uniform(n, "idx", "pos", seed=seed).alias("u"))
    return rows.mapInArrow(sample, "idx long, pos int, token_id int, count int")


def counted(draws: DataFrame) -> DataFrame:
    """idx, pos, token_id, count of single draws (idx, pos, token_id)."""
    return draws.groupBy("idx", "pos", "token_id").agg(F.count("*").alias("count"))


def rebuilt(counts: DataFrame, n: int) -> DataFrame:
    """counts as probabilities count / n."""
    return counts.withColumn("p", F.col("count") / F.lit(float(n)))


def valid(sparse: DataFrame, lengths: DataFrame) -> DataFrame:
    """Entries within each sequence's own length and with a real token; lengths: (idx, length)."""
    return sparse.join(lengths, "idx").filter((F.col("pos") < F.col("length")) & (F.col("token_id") >= 0)).drop("length")


def to_cache(sparse: DataFrame, per_shard: int) -> DataFrame:
    """shard_id, local_idx, idx, length, entries: one row a sequence, with positions in order and their number, for a
    table partitioned by shard. Probabilities are floats, the smallest kind that Spark has."""
    at = sparse.groupBy("idx", "pos").agg(F.array_sort(F.collect_list(F.struct(F.col("token_id"), F.col("p").cast("float").alias("p")))).alias("e"))
    rows = at.groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("pos", "e"))).alias("entries"))
    return rows.select(F.floor(F.col("idx") / per_shard).cast("int").alias("shard_id"), (F.col("idx") % per_shard).cast("int").alias("local_idx"), "idx", F.size("entries").alias("length"), "entries")


def write_cache(cache: DataFrame, path: str) -> None:
    """A cache as a table with a folder for each shard, rows in order there."""
    cache.repartition("shard_id").sortWithinPartitions("shard_id", "local_idx").write.partitionBy("shard_id").parquet(path)


def from_cache(cache: DataFrame) -> DataFrame:
    """idx, pos, token_id, p of a cache's rows."""
    at = cache.select("idx", F.explode("entries").alias("at")).select("idx", F.col("at.pos").alias("pos"), F.explode("at.e").alias("e"))
    return at.select("idx", "pos", F.col("e.token_id").alias("token_id"), F.col("e.p").cast("double").alias("p"))


def to_dense(entries: Column, vocab: int) -> Column:
    """An array of vocab probabilities from structs (token_id, p); tokens without an entry have 0."""
    held = F.array(F.map_from_entries(entries))
    return F.transform(held, lambda m: F.transform(F.sequence(F.lit(0), F.lit(vocab - 1)), lambda t: F.coalesce(F.try_element_at(m, t), F.lit(0.0))))[0]


def cross_entropy(logits: Column, label: Column) -> Column:
    """-log softmax(logits)[label] of a position; null where the label is null or no token."""
    top = F.array_max(logits).cast("double")
    total = F.aggregate(logits, F.lit(0.0), lambda s, v: s + F.exp(v.cast("double") - top))
    return top + F.ln(total) - F.get(logits, F.when(label >= 0, label).cast("int")).cast("double")


def kd_loss(teacher: DataFrame, student: DataFrame, mask: DataFrame) -> DataFrame:
    """idx, kd: minus the masked mean over positions of sum p * log q. teacher (idx, pos, token_id, p), student (idx,
    pos, token_id, logq; infinite ones count as 0), mask (idx, pos, mask). A sequence without a masked-in position is null."""
    terms = teacher.join(student, ["idx", "pos", "token_id"]).withColumn("x", F.when(F.abs("logq") == float("inf"), 0.0).otherwise(F.col("p") * F.col("logq")))
    at = terms.groupBy("idx", "pos").agg(F.sum("x").alias("x"))
    return mask.join(at, ["idx", "pos"], "left").groupBy("idx").agg((-F.try_divide(F.sum(F.coalesce("x", F.lit(0.0)) * F.col("mask")), F.sum("mask"))).alias("kd"))


def _against(entries: Column, logq: Column) -> Column:
    """sum p * log q of a position, where log q is a dense array: only the entries' own places are read."""
    term = lambda e, q: F.when(q.isNull() | (F.abs(q) == float("inf")), 0.0).otherwise(e["p"] * q)
    return F.aggregate(entries, F.lit(0.0), lambda s, e: s + term(e, F.get(logq, e["token_id"].cast("int"))))


def kd_losses_of_rows(teacher: DataFrame, student: DataFrame, mask: DataFrame) -> DataFrame:
    """idx, kd, entropy as kd_loss and entropy give them, from one row a position: teacher (idx, pos, entries: structs
    token_id, p), student (idx, pos, logq: an array over the vocabulary). Rows meet by (idx, pos); the vocabulary is
    never exploded."""
    both = teacher.join(student, ["idx", "pos"], "left")
    own = F.aggregate("entries", F.lit(0.0), lambda s, e: s + F.when(e["p"] > 0, e["p"] * F.ln(e["p"])).otherwise(0.0))
    at = mask.join(both.select("idx", "pos", _against(F.col("entries"), F.col("logq")).alias("_x"), own.alias("_e")), ["idx", "pos"], "left")
    mean = lambda c: -F.try_divide(F.sum(F.coalesce(c, F.lit(0.0)) * F.col("mask")), F.sum("mask"))
    return at.groupBy("idx").agg(mean("_x").alias("kd"), mean("_e").alias("entropy"))


def co_located(rows: DataFrame, name: str, buckets: int, key: str = "idx") -> DataFrame:
    """rows as a table in buckets of key, each one sorted file, in the shared folder: tables with as many buckets meet
    without a shuffle, as often as they are joined; the sort that Spark still plans finds its rows in order."""
    path = new_path(rows.sparkSession, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    rows.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    return rows.sparkSession.table(table)


def cached_losses(cache: DataFrame, student: DataFrame) -> DataFrame:
    """idx, kd, entropy of a written cache (idx, entries: to_cache) against student (idx, logq: an array over the vocabulary
    for each position, mask: one number for each position). A sequence's positions are one row on both sides, so nothing is
    grouped; co_located() tables are joined in place. A position without entries adds nothing; a sequence that the
    cache lacks, or without a masked-in position, has null."""
    both = student.join(cache.select("idx", "entries").hint("merge"), "idx", "left")

    def mean(term) -> Column:
        at = lambda e: F.coalesce(F.get("mask", e["pos"]), F.lit(0)) * term(e)
        total = F.aggregate("mask", F.lit(0.0), lambda s, m: s + m)
        return -F.try_divide(F.aggregate("entries", F.lit(0.0), lambda s, e: s + at(e)), total)

    own = lambda e: F.aggregate(e["e"], F.lit(0.0), lambda s, x: s + F.when(x["p"] > 0, x["p"].cast("double") * F.ln(x["p"].cast("double"))).otherwise(0.0))
    return both.select("idx", mean(lambda e: _against(e["e"], F.get("logq", e["pos"]))).alias("kd"), mean(own).alias("entropy"))


def entropy(teacher: DataFrame, mask: DataFrame) -> DataFrame:
    """idx, entropy: kd_loss of the teacher against itself."""
    return kd_loss(teacher, teacher.select("idx", "pos", "token_id", F.ln("p").alias("logq")), mask).withColumnRenamed("kd", "entropy")


def blended(lm: Column, kd: Column, ratio: float = 0.5) -> Column:
    return (1 - ratio) * lm + ratio * kd


def eval_means(losses: DataFrame, ratio: float = 0.5) -> DataFrame:
    """loss, lm_loss, kd_loss, kd_entropy, teacher_loss: means over rows (lm, kd, entropy, teacher) of an evaluation."""
    of = {"loss": blended(F.col("lm"), F.col("kd"), ratio), "lm_loss": F.col("lm"), "kd_loss": F.col("kd"), "kd_entropy": F.col("entropy"), "teacher_loss": F.col("teacher")}
    return losses.agg(*(F.avg(c).alias(name) for name, c in of.items()))


def masked_mean(losses: DataFrame, value: str = "loss", mask: str = "mask") -> DataFrame:
    """idx, mean of rows (idx, pos, loss, mask): null where nothing is masked in."""
    return losses.groupBy("idx").agg(F.try_divide(F.sum(F.when(F.col(mask) != 0, F.col(value) * F.col(mask)).otherwise(0.0)), F.sum(mask)).alias("mean"))
