"""Training batches as rows of fixed-width arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import pad
from millrace.operators.order import seeded


def _shifted(full: Column, size: Column, fill: Column, zero: Column) -> dict[str, Column]:
    n = F.greatest(F.size(full) - 1, F.lit(0))
    inputs = F.slice(full, F.lit(1), n)
    return {
        "input_ids": F.concat(inputs, F.array_repeat(fill, (size - n).cast("int"))),
        "attention_mask": F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), (size - n).cast("int"))),
        "position_ids": F.concat(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), F.array_repeat(F.lit(0), (size - n).cast("int"))),
        "label": F.concat(F.slice(full, F.lit(2), n), F.array_repeat(fill, (size - n).cast("int"))),
        "loss_mask": F.concat(zero, F.array_repeat(F.lit(0), (size - n).cast("int"))),
    }


def lm_batch(rows: DataFrame, length: int, pad_id: int, batch: Column | None = None) -> DataFrame:
    """idx, input_ids, attention_mask, position_ids, label, loss_mask of rows (idx, tokens): inputs and the tokens that
    follow them, at most `length`; a position whose input is pad counts for nothing. batch: rows of one batch are as
    wide as their longest needs, `length` at most."""
    size = F.lit(length)
    if batch is not None:
        rows = rows.withColumn("_size", F.least(F.max(F.size("tokens")).over(Window.partitionBy(batch)) - 1, F.lit(length)))
        size = F.col("_size")
    full = F.slice("tokens", F.lit(1), size + 1)
    fill = F.lit(pad_id).cast("int")
    mask = F.transform(F.slice(full, F.lit(1), F.greatest(F.size(full) - 1, F.lit(0))), lambda x: (x != pad_id).cast("int"))
    return rows.select("idx", *(v.alias(k) for k, v in _shifted(full, size, fill, mask).items()))


def lm_batch_gen(rows: DataFrame, pad_id: int, batch: Column) -> DataFrame:
    """idx, input_ids, attention_mask (prompt, padded on the left) and rest_ids (padded on the right), as wide as the
    longest of the batch, of rows (idx, prompt, rest)."""
    w = Window.partitionBy(batch)
    wide = rows.withColumns({"_p": F.max(F.size("prompt")).over(w), "_r": F.max(F.size("rest")).over(w)})
    fill = F.lit(pad_id).cast("int")
    left = F.array_repeat(fill, (F.col("_p") - F.size("prompt")).cast("int"))
    return wide.select("idx", F.concat(left, "prompt").alias("input_ids"), F.concat(F.transform(left, lambda _: F.lit(0)), F.transform("prompt", lambda _: F.lit(1))).alias("attention_mask"), F.concat("rest", F.array_repeat(fill, (F.col("_r") - F.size("rest")).cast("int"))).alias("rest_ids"))


def split_prompt(rows: DataFrame, mark: int) -> DataFrame:
    """rows (tokens) with prompt and response, the tokens before and after the first mark; without one it is an error."""
    at = F.array_position("tokens", F.lit(mark).cast("int"))
    at = F.when(at > 0, at.cast("int")).otherwise(F.raise_error(F.lit("no split token")).cast("int"))
    return rows.withColumn("_at", at).withColumns({"prompt": F.slice("tokens", F.lit(1), F.col("_at") - 1), "response": F.slice("tokens", F.col("_at") + 1, F.greatest(F.size("tokens") - F.col("_at"), F.lit(0)))}).drop("_at")


def truncate_prompt(rows: DataFrame, length: int, max_prompt: int, bos: int | None = None) -> DataFrame:
    """rows (prompt, response) that are longer than length + 1 together cut to that: the last max_prompt tokens of the
    prompt, a leading bos kept, then as much of the response as fits."""
    over = F.size("prompt") + F.size("response") > length + 1
    keep = F.slice("prompt", F.greatest(F.size("prompt") - max_prompt + 1, F.lit(1)), F.lit(max_prompt))
    if bos is not None:
        rest = F.slice("prompt", F.greatest(F.size("prompt") - max_prompt + 2, F.lit(2)), F.lit(max_prompt - 1))
        keep = F.when(F.get("prompt", F.lit(0)) == bos, F.concat(F.array(F.lit(bos).cast("int")), rest)).otherwise(keep)
    out = rows.withColumn("_p", F.when(over, keep).otherwise(F.col("prompt")))
    return out.withColumns({"response": F.when(over, F.slice("response", F.lit(1), F.greatest(F.lit(length + 1) - F.size("_p"), F.lit(0)))).otherwise(F.col("response")), "prompt": F.col("_p")}).drop("_p")


def prompt_batch(rows: DataFrame, length: int, pad_id: int, full_loss: bool = False) -> DataFrame:
    """Like lm_batch, of rows (idx, prompt, response); unless full_loss only the response is learned."""
    full = F.slice(F.concat("prompt", "response"), F.lit(1), F.lit(length + 1))
    start = F.lit(0) if full_loss else F.greatest(F.size("prompt") - 1, F.lit(0))
    mask = F.transform(F.slice(full, F.lit(1), F.greatest(F.size(full) - 1, F.lit(0))), lambda x, i: ((x != pad_id) & (i >= start)).cast("int"))
    return rows.select("idx", *(v.alias(k) for k, v in _shifted(full, F.lit(length), F.lit(pad_id).cast("int"), mask).items()))


def next_tokens(rows: DataFrame) -> DataFrame:
    """idx, pos, token, next of rows (idx, tokens): one row for each token that has a follower."""
    pairs = F.arrays_zip(F.slice("tokens", F.lit(1), F.size("tokens") - 1).alias("token"), F.slice("tokens", F.lit(2), F.size("tokens") - 1).alias("next"))
    return rows.filter(F.size("tokens") > 1).select("idx", F.posexplode(pairs).alias("pos", "p")).select("idx", "pos", "p.token", "p.next")


def permutation(rows: DataFrame, epochs: int, seed: int = 1234) -> DataFrame:
    """epoch, key, idx: rows in a new seeded order each epoch. Sorting by key within an epoch gives the order; it is the
    same whatever the partitions, and needs no row numbers."""
    each = rows.select("idx", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    return each.select("epoch", seeded("epoch", "idx", seed=seed).alias("key"), "idx")


def order_matrix(rows: DataFrame, epochs: int, seed: int = 1234) -> DataFrame:
    """epoch, pos, idx: the permutations as positions."""
    from millrace.operators.order import row_number

    keyed = permutation(rows, epochs, seed).withColumn("_h", F.conv(F.substring("key", 1, 12), 16, 10).cast("long"))
    return row_number(keyed, ["_h", "key", "idx"], "pos", ["epoch"]).select("epoch", "pos", "idx")


def in_order(order: DataFrame, rows: DataFrame) -> DataFrame:
    """rows by epoch and position."""
    return order.join(rows, "idx")


def not_skipped(rows: DataFrame, epoch: int, pos: int) -> DataFrame:
    """Rows from (epoch, pos) on, in lexicographic order."""
    return rows.filter(F.struct("epoch", "pos") >= F.struct(F.lit(epoch).cast(rows.schema["epoch"].dataType), F.lit(pos).cast(rows.schema["pos"].dataType)))


def batches_not_skipped(rows: DataFrame, epoch: int, pos: int, batch: int) -> DataFrame:
    """Rows of the batches whose first row is at (epoch, pos) or later: a batch that was begun goes whole."""
    first = F.floor(F.col("pos") / batch) * batch
    return rows.filter((F.col("epoch") > epoch) | (F.col("epoch") == epoch) & (first >= pos))


def drop_last(rows: DataFrame, batch: int, pos: str = "pos") -> DataFrame:
    """Rows in whole batches."""
    n = rows.count()
    return rows.filter(F.col(pos) < n // batch * batch).withColumn("step", F.floor(F.col(pos) / batch))


def to_workers(rows: DataFrame, workers: int) -> DataFrame:
    """rows with the worker that has them (round robin) and their place there; idx alone restores the order."""
    return rows.withColumns({"worker": F.pmod("idx", F.lit(workers)).cast("int"), "turn": F.floor(F.col("idx") / workers)})
