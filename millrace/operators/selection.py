"""Scores: joins by row number, statistics, distribution, ranking, selection, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.order import row_number, seeded, stored


def difference(large: DataFrame, small: DataFrame, strict: bool = True) -> DataFrame:
    """idx, large, small, diff = small - large of two score tables (idx, score). strict: a row in one alone is an error."""
    both = large.select("idx", F.col("score").alias("large")).join(small.select("idx", F.col("score").alias("small")), "idx", "full" if strict else "inner")
    if strict:
        both = both.withColumn("small", F.when(F.col("large").isNull() | F.col("small").isNull(), F.raise_error(F.concat(F.lit("score without a counterpart at row "), F.col("idx").cast("string")))).otherwise(F.col("small")))
    return both.withColumn("diff", F.col("small") - F.col("large"))


def against_dataset(dataset: DataFrame, scores: DataFrame, key: str = "idx") -> DataFrame:
    """Rows of dataset with their scores; a row without a score, or a score without a row, is an error."""
    both = dataset.withColumn("_row", F.lit(True)).join(scores.withColumn("_score", F.lit(True)), key, "full")
    whole = F.col("_row").isNotNull() & F.col("_score").isNotNull()
    return both.filter(F.when(whole, True).otherwise(F.raise_error(F.concat(F.lit("dataset and scores differ at "), F.col(key).cast("string"))).cast("boolean"))).drop("_row", "_score")


def stats(scores: DataFrame, value: str) -> DataFrame:
    """One row: n, mean, highest, lowest, nans. NaN is counted apart and left out of the others."""
    v = F.when(~F.isnan(value), F.col(value))
    return scores.agg(F.count(value).alias("n"), F.avg(v).alias("mean"), F.max(v).alias("highest"), F.min(v).alias("lowest"), F.sum(F.isnan(value).cast("long")).alias("nans"))


def histogram(scores: DataFrame, value: str, bins: int = 10_000) -> DataFrame:
    """bin, n, density, cumulative over equal widths from least to greatest; empty bins have no row. The greatest value
    is in the last bin; a single value fills the first one. Null and NaN are left out."""
    scores = scores.filter(~F.isnan(value))
    low, high, total = scores.agg(F.min(value), F.max(value), F.count(value)).first()
    if not total:
        return scores.sparkSession.createDataFrame([], "bin long, n long, density double, cumulative double")
    width = (high - low) / bins if high > low else 1.0 / bins
    place = F.least(F.floor((F.col(value) - low) / F.lit(width)), F.lit(bins - 1)) if high > low else F.lit(0)
    counts = scores.groupBy(place.cast("long").alias("bin")).agg(F.count("*").alias("n"))
    running = F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))  # at most `bins` rows
    return counts.select("bin", "n", (F.col("n") / F.lit(total * width)).alias("density"), (running / F.lit(total)).alias("cumulative"))


def ranked(scores: DataFrame, value: str, digits: int = 9) -> DataFrame:
    """scores with rank from 0, highest value first, ties by idx; values are compared after rounding."""
    return row_number(scores.withColumn("_r", -F.round(value, digits)), ["_r", "idx"], "rank").drop("_r")


def top_fraction(scores: DataFrame, value: str, ratio: float) -> DataFrame:
    """The floor(ratio * n) highest rows, in no order; sort by idx to have the corpus order back."""
    n = scores.count()
    return ranked(scores, value).filter(F.col("rank") < int(ratio * n))


def bottom_fraction(scores: DataFrame, value: str, ratio: float) -> DataFrame:
    """The floor(ratio * n) lowest rows; none if that is zero."""
    n = scores.count()
    return ranked(scores, value).filter(F.col("rank") >= n - int(ratio * n))


def top(scores: DataFrame, value: str, k: int = 1000, lowest: bool = False, digits: int = 9) -> DataFrame:
    """The k highest (or lowest) rows with rank (or place from the end), found as a limit: no task sorts the table."""
    r = F.round(value, digits)
    first = scores.orderBy(*((r.asc(), F.col("idx").desc()) if lowest else (r.desc(), F.col("idx").asc()))).limit(k)
    order = Window.orderBy(r.desc(), F.col("idx").asc())  # k rows
    return first.withColumn("place", F.row_number().over(order) - 1)


def sample_rows(rows: DataFrame, k: int, seed: int = 42, key: str = "idx") -> DataFrame:
    """k distinct rows in a seeded order that depends on the key alone; all rows if there are fewer."""
    return rows.orderBy(seeded(key, seed=seed), key).limit(k)


def reports(scores: DataFrame, value: str, fractions: tuple[float, ...] = (0.001, 0.01, 0.1), k: int = 1000, seed: int = 42) -> DataFrame:
    """report, idx, value: the top and bottom k, and k random rows of each top and bottom fraction."""
    n = scores.count()
    all_ = stored(ranked(scores, value).select("idx", F.col(value).alias("value"), "rank"))
    out = top(scores, value, k).select(F.lit("top").alias("report"), "idx", F.col(value).alias("value"))
    out = out.union(top(scores, value, k, lowest=True).select(F.lit("bottom").alias("report"), "idx", F.col(value).alias("value")))
    for f in fractions:
        for name, keep in ((f"top_{f:g}", F.col("rank") < int(f * n)), (f"bottom_{f:g}", F.col("rank") >= n - int(f * n))):
            out = out.union(sample_rows(all_.filter(keep), k, seed).select(F.lit(name).alias("report"), "idx", "value"))
    return out


def report_rows(report: DataFrame, scores: DataFrame, dataset: DataFrame) -> DataFrame:
    """report with both models' scores and the row of dataset of each idx. A report has a stated number of rows: it is sent
    to the tables, which stay where they are."""
    return F.broadcast(F.broadcast(report).join(scores.select("idx", "large", "small"), "idx")).join(dataset, "idx")


def report_lines(report: DataFrame, texts: DataFrame) -> DataFrame:
    """value: one block of text for each report row, with its scores; for a text sink. The texts stay where
    they are, as a report has a stated number of rows."""
    return F.broadcast(report).join(texts, "idx").select(F.format_string("##### %s | idx %d | score %.4f #####\n%s\n", "report", "idx", "value", "text").alias("value"))


def keep_rows(table: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of table whose idx was chosen."""
    return table.join(chosen.select("idx"), "idx", "left_semi")


def not_done(table: DataFrame, done: DataFrame, key: str = "idx") -> DataFrame:
    """Rows that have no output yet: what a restarted job has to do."""
    return table.join(done.select(key), key, "left_anti")


def assert_disjoint(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """n_shared: keys that both tables have; training and held-out data must share none."""
    return a.select(key).intersect(b.select(key)).agg(F.count("*").alias("n_shared"))


def fails_past(error: Column, most: int) -> Column:
    """True once more rows than `most` have an error; for an aggregate over a shard's results."""
    return F.count(error) > most
