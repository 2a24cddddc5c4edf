"""The queries of this subpackage: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import katz, mixing, ngram_join, packing, periodic, pii, quality, spotsigs, suffix_dedup, token_ids, topk, toxicity, wavelet
from millrace.llm.store import cut, shared_dir


def tokenizer_path(name: str) -> str:
    """Where the installed public vocabulary file of that name lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_neighbours(documents(spark, sf_dir), rising=True)


def op2_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(documents(spark, sf_dir), F.crc32(F.col("doc_id").cast("string")) % 5 != 1)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out)
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.learn(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), end=0, capacity=2048)


def op5_elias_fano_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/millrace-ids-{uuid.uuid4().hex}"
    token_ids.write(documents(spark, sf_dir), path, tokenizer_path("byte_bpe_50k.json"), end=0)
    return token_ids.read(spark, path)


def op6_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    base = quality.base(docs)
    # the base verdict stands for the two rules it is made of
    others = [r for r in quality.rules(counted=True) if r.name not in ("few_words", "repeated_words")]
    out = quality.cascade(base, others, after=F.col("base_failed"), measured=quality.base(quality.sample(docs)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("rejected_by").isNull().alias("kept"))


def op7_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find(documents(spark, sf_dir).select("doc_id", "text"))
    counts = {f"n_{k}": pii.count(F.col("base_spans"), k) for k in pii.BASE}
    return out.withColumns(counts | {"base_sha256": F.sha2(pii.joined(F.col("base_spans")), 256), "_all": pii.joined(F.col("spans"))}).select("doc_id", *counts, "base_sha256", F.col("_all").alias("spans"))


def op8_suffix_array_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(documents(spark, sf_dir), length=100).drop("spans")


def op9_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(documents(spark, sf_dir), shingle=3, percent=90).drop("text_hash")


def op11_histogram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.search(vectors, vectors.filter("vec_id % 50 = 0"), k=5, scale=256.0)


def op12_wavelet_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = wavelet.index(documents(spark, sf_dir))
    found = cut(wavelet.search(shards, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=20))
    shards.table.remove()
    return found


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.find(documents(spark, sf_dir), edit=True, texts=False).drop("runs", "collapsed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_spotsigs": op1_spotsigs,
    "op2_katz_backoff": op2_katz_backoff,
    "op3_toxicity": op3_toxicity,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_elias_fano_ids": op5_elias_fano_ids,
    "op6_quality_cascade": op6_quality_cascade,
    "op7_pii_boosting": op7_pii_boosting,
    "op8_suffix_array_family": op8_suffix_array_family,
    "op9_sainte_lague_mix": op9_sainte_lague_mix,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_histogram_topk": op11_histogram_topk,
    "op12_wavelet_search": op12_wavelet_search,
    "op13_periodic_runs": op13_periodic_runs,
}

_WORD = r"[^\x20\x09-\x0D]+"
_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op6_quality_cascade": rf"""
with t as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '{_WORD}') as ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) as ls from t),
g as (select r, unnest(range(1, len(ws) - 1)) as i, ws from w where len(ws) >= 3),
h as (select r, i, count(*) over (partition by r, ws[i], ws[i + 1], ws[i + 2]) as n from g),
p as (select r, i, lead(i) over (partition by r order by i) as j from h where n > 1),
q as (select r, sum(least(3, coalesce(j - i, 3))) as n_repeat_words from p group by r),
b as (select doc_id, text, cast(len(ws) as bigint) as n_words,
        cast(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
        cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
        cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, len(ls) as n_lines,
        cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words
      from w left join q using (r)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 10 * n_symbols > 3 * n_words or word_chars < 2 * n_words or word_chars > 20 * n_words
    or 100 * n_dup_lines > 60 * n_lines
    or 2 * length(regexp_replace(text, '[^\p{{L}}]+', '', 'g')) < word_chars) as kept
from f""",
    "op8_suffix_array_family": """
with t as materialized (select row_number() over (order by doc_id) as r, doc_id, encode(coalesce(text, '')) as x from documents),
w as (select r, p, r * 4294967296 + p as g, x[p + 1:p + 100] as s from (select r, x, unnest(range(octet_length(x) - 99)) as p from t)),
m as (select r, p from w qualify g > min(g) over (partition by s)),
u as (select r, p, coalesce(p - lag(p) over (partition by r order by p) > 100, true)::int as opens from m),
v as (select r, p, sum(opens) over (partition by r order by p) as run from u),
c as (select r, run, min(p) as a, max(p) + 100 as b from v group by r, run),
k as (select r, run, a, b, coalesce(lag(b) over (partition by r order by a), 0) as z from c),
j as (select k.r, count(*) as n_spans, sum(b - a) as n_removed, max(b) as z, string_agg(hex(x[z + 1:a]), '' order by a) as kept from k join t using (r) group by k.r)
select doc_id, cast(octet_length(x) as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(coalesce(kept, '') || hex(x[coalesce(z, 0) + 1:octet_length(x)]))) as kept_sha256
from t left join j using (r)""",
    "op10_ngram_jaccard_join": rf"""
with recursive t as materialized (select row_number() over () as r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') as ws from documents),
e as (select distinct r, array_to_string(ws[i:i + 2], ' ') as g from (select r, ws, unnest(range(1, greatest(len(ws) - 1, least(len(ws), 1) + 1))) as i from t)),
s as (select r, md5(string_agg(g, chr(10) order by g)) as k, count(*) as n from e group by r),
d as (select k, n, min(r) as r from s group by k, n),
x as (select k, n, g from d join e using (r)),
l as (select a.k as a, b.k as b from x a join x b on a.g = b.g and a.k <> b.k and 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)
        group by a.k, b.k, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
c as (select k, k as o from d union select c.k, l.b from c join l on l.a = c.o),
m as (select c.k, min(doc_id) as component_id from c join s on s.k = c.o join t using (r) group by c.k)
select doc_id, coalesce(n, 0) as n_shingles, case when s.k is null then doc_id else component_id end as component_id
from t left join s using (r) left join m on m.k = s.k""",
    "op11_histogram_topk": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
        where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id)
select query_id, cast(row_number() over w as int) as rank, vec_id, score from s
window w as (partition by query_id order by score desc, vec_id) qualify row_number() over w <= 5""",
    "op12_wavelet_search": f"""
with d as (select row_number() over () as r, doc_id, {_TERMS} as ts from documents),
g as (select count(*) as n, sum(len(ts))::bigint as l from d where len(ts) > 0),
p as (select r, t, count(*) as tf from (select r, unnest(ts) as t from d) group by all),
f as (select t, count(*) as df from p group by t),
b as (select row_number() over () as i, item_id, {_TERMS} as ts from benchmark),
q as (select i, item_id, t, count(*) as times from (select i, item_id, unnest(ts) as t from b) group by all),
s as (select i, item_id, r, sum(times * floor(1000 * ln((2 * n + 2) / (2 * df + 1)))::bigint * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(ts) * n) // l))))::bigint as score
        from q join f using (t) join p using (t) join (select r, ts from d) using (r), g group by all)
select item_id, cast(row_number() over w as int) as rank, doc_id, score from s join (select r, doc_id from d) using (r) where score > 0
window w as (partition by i order by score desc, doc_id nulls last) qualify row_number() over w <= 20""",
}
