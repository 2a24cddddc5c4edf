"""A training-data pipeline over documents: drop toxic texts, keep one of each group of near-duplicates, redact personal
data, mix sources to target weights, pack what is left into sequences. Each stage reads all that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import mixing, ngram_join, packing, pii, toxicity
from millrace.llm.queries import tokenizer_path
from millrace.llm.store import cut, hold, release


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below 0.3 for toxicity, under models learned from the labels of these documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score(hold(docs, "doc_id", "text"), toxicity.learn(docs, labels))
    return release(scored.filter("score < 0.3"), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of texts that share 0.8 of their 5-word shingles or more: the one whose doc_id is the
    component's least (null only if all are), of its texts the one of the least hash. Rows without words are all kept."""
    found = ngram_join.join(docs, shingle=5, percent=80, root=True)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "text_hash")).alias("_first")
    whole = found.filter("n_shingles > 0").groupBy("root").agg(first).select("_first.doc_id", "_first.text_hash")
    keep = whole.union(found.filter("n_shingles = 0").select("doc_id", "text_hash")).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"))
    kept = hold(docs, "doc_id", "text").withColumn("_h", F.xxhash64("text")).join(keep, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_t")), "left_semi")
    # a repeated row is a copy of itself
    nth = F.row_number().over(Window.partitionBy("doc_id", "_h").orderBy("_h"))
    kept = kept.withColumn("_n", nth).filter((F.col("_n") == 1) | ~F.coalesce(F.col("text"), F.lit("")).rlike(mixing.WORD))
    return release(kept, docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with each span of personal data replaced by its kind in angle brackets; n_chars follows."""
    out = release(pii.redact(pii.find(hold(docs, "text"))), docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the mix by source weights 1, 2, 3, repeating: a row for each copy taken."""
    held = hold(docs, "doc_id", "text", "source")
    out = release(mixing.emit(mixing.mix(held)), docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts in sequences of at most 2048 ids."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), end=0, capacity=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("sainte_lague_mix", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Toxicity, trees and packing have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, writing each one's result to the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
