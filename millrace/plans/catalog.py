"""Registered queries over the test tables, and the same in SQL.

Raw doubles are rounded where they are compared or returned. SQL strings are for an engine that has list functions and
`lambda x: ...`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import schedules
from millrace.functions import text as X
from millrace.operators import batching, corpus, distill, evaluation, inference, retokenize, selection, sequences, shuffle, udtf, vocabulary
from millrace.operators.order import new_path, prefix_sum, row_number, seeded, stored
from millrace.sources import binidx, files
from millrace.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
PACK, SHARD = 256, 500


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ids_of(tokens: Column) -> Column:
    """Small integers that stand for tokens: a token's first character's code."""
    return F.transform(tokens, lambda t: F.ascii(t))


TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+|[^a-z0-9\s]')"
IDS = f"list_transform({TOKENS}, lambda t: unicode(t))"
SCORES = f"""
w as (select doc_id, source, tok, count(*) as n from (select doc_id, source, unnest({TOKENS}) as tok from documents) group by all),
own as (select source, tok, sum(n) as c_own from w group by all),
tot as (select source, sum(c_own) as n_own from own group by all),
ref as (select tok, sum(n) as c_ref from w where doc_id % 20 = 0 group by all),
sz as (select coalesce(sum(c_ref), 0) as n_ref, count(*) as v_ref from ref),
sc as (select doc_id as idx, sum(-ln(c_own / n_own) * n) / sum(n) as large,
         sum(-ln((coalesce(c_ref, 0) + 1) / cast(n_ref + v_ref + 1 as double)) * n) / sum(n) as small
       from w join own using (source, tok) join tot using (source) left join ref using (tok), sz group by doc_id),
s as (select idx, large, small, small - large as diff from sc),
r as (select *, row_number() over (order by round(diff, 9) desc, idx) - 1 as rank, count(*) over () as total from s)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores as a narrow table, written once: ranks, statistics and reports read it several times."""
    scores = corpus.language_model_scores(table(spark, sf_dir, "documents"))
    return stored(scores.withColumn("diff", F.col("small") - F.col("large")))


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


# Corpus building


@query(f"select doc_id, cast(len(t) as bigint) as n_tokens, t[1] as first, t[-1] as last from (select doc_id, list_append({TOKENS}, '<eos>') as t from documents)")
def tokenize_docs(spark, sf_dir):
    e = corpus.encode(table(spark, sf_dir, "documents"))
    return e.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.get("tokens", F.lit(0)).alias("first"), F.element_at("tokens", -1).alias("last"))


@query(f"select tok, count(*) as n, count(distinct doc_id) as docs from (select doc_id, unnest({TOKENS}) as tok from documents) group by tok")
def token_counts(spark, sf_dir):
    per_doc = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.tokenize(F.col("text"))).alias("tok")).groupBy("doc_id", "tok").agg(F.count("*").alias("k"))
    return per_doc.groupBy("tok").agg(F.sum("k").alias("n"), F.count("*").alias("docs"))


_VOCAB = r"select distinct unnest(regexp_extract_all(text, '[A-Za-z0-9]*[^A-Za-z0-9]')) as piece from documents"


@query(rf"""select piece, (ends and ok) as ends_sentence, (ends and ok and contains(piece, chr(10))) as newline from (select piece,
contains(piece, '.') or contains(piece, '!') or contains(piece, '?') or contains(piece, ';') or contains(piece, chr(10)) as ends,
(not contains(piece, '[') or contains(piece, ']')) and (not contains(piece, '(') or contains(piece, ')')) and (not contains(piece, '{{') or contains(piece, '}}')) and (not contains(piece, '<') or contains(piece, '>')) as ok from ({_VOCAB}))""")
def end_token_set(spark, sf_dir):
    pieces = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]*[^A-Za-z0-9]"), F.lit(0))).alias("piece")).distinct()
    return corpus.end_pieces(pieces)


@query("select doc_id, cast(substr(source, 4) as int) as domain_id from documents")
def domain_lookup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    domains = docs.select(F.col("source").alias("name")).distinct().withColumn("id", F.expr("cast(substr(name, 4) as int)"))
    return corpus.with_domain(docs, domains).select("doc_id", "domain_id")


@query("select name, row_number() over (order by md5('233:' || name), name) - 1 as place from (select distinct source as name from documents)")
def file_order(spark, sf_dir):
    return corpus.file_order(table(spark, sf_dir, "documents").select(F.col("source").alias("name")).distinct()).withColumn("place", F.col("place").cast("long"))


_PACKED = f"""
e as (select doc_id, source as domain, length(text) as n_chars, list_append({TOKENS}, '<eos>') as t from documents),
p as (select *, coalesce(sum(len(t)) over (partition by domain order by doc_id rows between unbounded preceding and 1 preceding), 0) as start from e),
x as (select domain, start + i - 1 as pos, t[i] as tok from (select domain, start, t, unnest(range(1, len(t) + 1)) as i from p)),
c as (select domain, cast(pos // {PACK} as bigint) as chunk, count(*) as n_tokens, string_agg(tok, ' ' order by pos) as joined from x group by all having count(*) = {PACK})"""


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.pack_fixed(corpus.encode(table(spark, sf_dir, "documents")), PACK)


@query(f"with {_PACKED} select domain, chunk, n_tokens, md5(joined) as digest from c")
def pack_fixed(spark, sf_dir):
    return packed(spark, sf_dir).select("domain", "chunk", "n_tokens", F.md5(F.array_join("tokens", " ")).alias("digest"))


@query(f"""with {_PACKED},
a as (select domain, count(*) as docs, cast(sum(n_chars) as bigint) as chars from e group by rollup (domain)),
b as (select domain, count(*) as chunks, cast(sum(n_tokens) as bigint) as tokens from c group by rollup (domain))
select a.domain, docs, chars, coalesce(chunks, 0) as chunks, coalesce(tokens, 0) as tokens,
  case when chunks > 0 then round((chunks * {PACK} - tokens) / cast(chunks * {PACK} as double), 6) else 0.0 end as padding
from a left join b on a.domain is not distinct from b.domain""")
def pack_stats(spark, sf_dir):
    e = corpus.encode(table(spark, sf_dir, "documents"))
    return rounded(corpus.pack_stats(corpus.pack_fixed(e, PACK), e, PACK), "padding")


def vocabulary_file(name: str) -> str:
    """Where an installed public vocabulary of merge ranks lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


ONE, OTHER = "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"
END = 50256  # the id after the last of both vocabularies


@query("select doc_id, md5(coalesce(text, '')) as digest, cast(1 as boolean) as fewer from documents")
def decoded_documents(spark, sf_dir):
    """Every whole text, encoded with a vocabulary of merge ranks and decoded; no text has more tokens than bytes."""
    tokens = vocabulary.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_file(ONE))
    texts = vocabulary.decode(tokens.withColumn("n", F.size("tokens")), vocabulary_file(ONE))
    return texts.select("doc_id", F.md5("text").alias("digest"), (F.col("n") <= F.octet_length("text")).alias("fewer"))


@query("select doc_id as idx, md5(coalesce(text, '')) as digest, cast(1 as int) as parts from documents")
def retokenized_documents(spark, sf_dir):
    """Every document's ids in one vocabulary turned into another one's, which decode to the same text."""
    one = vocabulary.encode(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), "text"), vocabulary_file(ONE))
    other = vocabulary.retokenize(one, vocabulary_file(ONE), vocabulary_file(OTHER), old_end=END, new_end=END, length=1 << 30, bos=END)
    back = vocabulary.decode(other.withColumn("tokens", F.slice("tokens", F.lit(2), F.size("tokens"))), vocabulary_file(OTHER), end=END, name="parts")
    return back.select("idx", F.md5(F.array_join("parts", "")).alias("digest"), F.size("parts").alias("parts"))


@query()
def pack_encoded_sentences(spark, sf_dir):
    """Sentence-bounded chunks of each domain's ids, with the sentence ends that the vocabulary itself gives."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("domain"), "text")
    return vocabulary.pack(docs, vocabulary_file(ONE), PACK, END).select("domain", "stream", "seq", "padding", F.size("tokens").alias("n_tokens"), F.md5(F.array_join(F.col("tokens").cast("array<string>"), ",")).alias("digest"))


@query(rf"""with recursive e as (select source as domain, row_number() over (partition by source order by doc_id) - 1 as rank,
        list_append(regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]?[A-Za-z0-9]+|[^A-Za-z0-9]'), '') as t from documents),
o as (select *, coalesce(sum(len(t)) over (partition by domain order by rank rows between unbounded preceding and 1 preceding), 0)::bigint as start from e),
x as (select domain, rank, start + i - 1 as pos, t[i] as tok from (select domain, rank, start, t, unnest(range(1, len(t) + 1)) as i from o)),
f as (select domain, rank, pos, tok = '' or tok[-1] = chr(10)
        or tok[-1] in ('!', '.', ';', '?') and (contains(tok, ' ') or coalesce(contains(lead(tok) over w, ' '), false)) as ends from x window w as (partition by domain order by pos)),
g as (select domain, rank, pos, max(case when ends then pos end) over (partition by domain order by pos) as last_end from f),
n as materialized (select domain, rank, pos - {PACK - 1} as a, case when last_end >= pos - {PACK - 1} then last_end + 1 else pos + 1 end as stop from g where pos >= {PACK - 1}),
c as (select domain, rank, a, stop from n where a = 0 union all
  select n.domain, n.rank, n.a, n.stop from c join n on n.domain = c.domain and n.a = c.stop),
k as (select domain, cast(rank // 10000 as int) as stream, a, cast(stop - a as int) as n_tokens from c where stop - a > 1)
select domain, stream, cast(row_number() over (partition by domain, stream order by a) - 1 as int) as seq, n_tokens, {PACK} - n_tokens as padding from k""")
def pack_sentences(spark, sf_dir):
    out = corpus.pack_sentences(piece_codes(spark, sf_dir), PACK, eos=0, ends=[33, 46, 59, 63], newlines=[10])
    return out.select("domain", "stream", "seq", F.size("tokens").alias("n_tokens"), "padding")


def piece_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, domain, tokens, spaced: each piece of a text as the code of its last character, and an end."""
    docs = table(spark, sf_dir, "documents")
    pieces = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\s?[A-Za-z0-9]+|[^A-Za-z0-9]"), F.lit(0))
    e = docs.select("doc_id", F.col("source").alias("domain"), F.array_append(pieces, F.lit("")).alias("p"))
    return e.select("doc_id", "domain", F.transform("p", lambda t: F.when(t == "", 0).otherwise(F.ascii(F.right(t, F.lit(1))))).alias("tokens"), F.transform("p", lambda t: F.contains(t, F.lit(" "))).alias("spaced"))


@query(ORACLES["pack_sentences"].split("select domain, stream, cast(row_number()")[0] + f"select domain, cast(row_number() over (partition by domain order by a) - 1 as int) as seq, n_tokens, {PACK} - n_tokens as padding from k")
def pack_sentences_in_sql(spark, sf_dir):
    """The same chunks from a SQL statement."""
    udtf.register(spark)
    piece_codes(spark, sf_dir).createOrReplaceTempView("piece_codes")
    return spark.sql(f"select domain, seq, size(tokens) as n_tokens, padding from pack_sentences(table(piece_codes) partition by domain order by (doc_id), {PACK}, 0, array(33, 46, 59, 63), array(10))")


_LENGTHS = f"l as (select doc_id as idx, len({TOKENS}) as n, {IDS} as t from documents)"


def rows_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, tokens of each document, as small integers."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), ids_of(X.tokenize(F.col("text"))).alias("tokens"))


@query(f"with {_LENGTHS} select cast(max(n) as int) as longest, cast(min(n) as int) as shortest, round(avg(n), 6) as mean from l")
def length_stats(spark, sf_dir):
    return rounded(sequences.length_stats(rows_of(spark, sf_dir)), "mean")


@query(f"with {_LENGTHS} select idx, cast(n as int) as n from l where n > 60")
def short_rows_dropped(spark, sf_dir):
    return rows_of(spark, sf_dir).select("idx", F.size("tokens").alias("n")).filter("n > 60")


# Sequences and shards


def sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.into_shards(table(spark, sf_dir, "documents").select("doc_id", "source"), ["doc_id"], SHARD)


_SHARDED = f"q as (select doc_id, source, row_number() over (order by doc_id) - 1 as idx from documents), h as (select *, cast(idx // {SHARD} as int) as shard, cast(idx % {SHARD} as int) as local_idx from q)"
_MANIFEST = f"{_SHARDED}, m as (select shard, count(*) as n, min(idx) as lo, max(idx) + 1 as hi from h group by shard)"


@query(f"with {_SHARDED} select doc_id, idx, shard, local_idx from h")
def shard_rows(spark, sf_dir):
    return sharded(spark, sf_dir).select("doc_id", "idx", "shard", "local_idx")


@query(f"with {_SHARDED} select doc_id, shard, cast(row_number() over (partition by shard order by md5('10:' || idx), idx) - 1 as int) as local_idx from h")
def shard_rows_shuffled(spark, sf_dir):
    return sequences.into_shards(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], SHARD, shuffle_seed=10).select("doc_id", "shard", "local_idx")


@query(f"with {_MANIFEST} select * from m")
def shard_manifest(spark, sf_dir):
    return sequences.manifest(sharded(spark, sf_dir))


@query(f"with {_MANIFEST} select idx, m.shard, idx - lo as local_idx from q join m on lo <= idx and idx < hi")
def locate_all_rows(spark, sf_dir):
    rows = sharded(spark, sf_dir)
    return sequences.locate(rows.select("idx"), sequences.manifest(rows))


@query(f"with {_SHARDED} select doc_id, idx - 120 as idx from h where idx >= 120 and idx < 870")
def offset_range(spark, sf_dir):
    return sequences.between(sharded(spark, sf_dir), 120, 870).select("doc_id", "idx")


@query(f"with {_SHARDED}, n as (select count(*) as n from h) select doc_id, idx - cast(floor(0.25 * n) as bigint) as idx from h, n where idx >= floor(0.25 * n) and idx < floor(0.8 * n)")
def ratio_range(spark, sf_dir):
    return sequences.between_ratios(sharded(spark, sf_dir), 0.25, 0.8).select("doc_id", "idx")


@query(f"with {_LENGTHS} select idx, list_aggregate(t[11:15], 'string_agg', ',') as part from l")
def part_of_rows(spark, sf_dir):
    part = sequences.part_of_row(F.col("tokens"), 10, 5)
    return rows_of(spark, sf_dir).select("idx", F.when(F.size(part) > 0, F.array_join(part.cast("array<string>"), ",")).alias("part"))


@query(f"with {_SHARDED} select doc_id, shard - 1 as shard from h where shard between 1 and 1")
def hold_out_shards(spark, sf_dir):
    return sequences.hold_out(sharded(spark, sf_dir), 1, 1).select("doc_id", "shard")


@query(f"with {_SHARDED} select count(*) as n_shared from (select doc_id from h where shard = 1 intersect select doc_id from h where shard <> 1)")
def held_out_shards_are_disjoint(spark, sf_dir):
    """Shares of the held-out shards with all others: rows are split by place, so a repeated id can be in both."""
    rows = sharded(spark, sf_dir)
    return selection.assert_disjoint(rows.filter("shard <> 1"), sequences.hold_out(rows, 1, 1), "doc_id")


@query("select doc_id as idx, cast(coalesce(sum(case when length(text) < 400 then 1 else 0 end) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) as doc from documents")
def document_boundaries(spark, sf_dir):
    sized = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), F.when(F.length("text") < 400, 0).otherwise(F.length("text")).alias("size"))
    return corpus.doc_boundaries(sized).select("idx", "doc")


@query("select name, cast(coalesce(try_cast(regexp_extract(name, '_([0-9]+)\\.', 1) as int), 0) as int) as number from (select distinct 'scores_' || (doc_id % 23) || '.pt' as name from documents)")
def numeric_file_order(spark, sf_dir):
    names = table(spark, sf_dir, "documents").select(F.concat(F.lit("scores_"), (F.col("doc_id") % 23).cast("string"), F.lit(".pt")).alias("name")).distinct()
    return names.withColumn("number", X.trailing_number(F.col("name")))


# Scores and selection


_COUNTED = "l as (select doc_id as idx, " + IDS + """ as t from documents), u as (select idx, unnest(t) as tok from l), c as (select tok, count(*) as n from u group by tok), s as (select sum(n) as total from c),
v as (select idx, round(avg(-ln(n / total::double)), 6) as loss from u join c using (tok), s group by idx) select idx, loss from l left join v using (idx)"""


def counted_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """idx, shard, tokens of the documents, and where the counts of their tokens have been written."""
    rows = stored(rows_of(spark, sf_dir).withColumn("shard", F.floor(F.col("idx") / SHARD).cast("int")))
    path = new_path(spark, "counts")
    inference.learn_counts(rows, path)
    return rows, path


@query(f"with {_COUNTED}")
def inferred_scores(spark, sf_dir):
    """Every document's loss under a count model that each worker loads once, in batches of like lengths."""
    rows, path = counted_rows(spark, sf_dir)
    return rounded(inference.score_batches(rows, path, lambda: inference.count_model(path)).select("idx", "loss"), "loss")


@query(f"with {_COUNTED}")
def scores_after_failures(spark, sf_dir):
    """The same by two runs, the first with a model that fails on long rows past the budget of a shard: what it left is
    done by the second, each row once."""
    rows, path = counted_rows(spark, sf_dir)
    out = new_path(spark, "runs")

    def unsound():
        score = inference.count_model(path)

        def run(batch):
            if max(map(len, batch)) > 300:
                raise RuntimeError("too long")
            return score(batch)

        return run

    inference.score_rest(rows, out, f"{path}-unsound", unsound, batch=16, budget=2)
    inference.score_rest(rows, out, path, lambda: inference.count_model(path), batch=16, budget=0)
    return rounded(inference.done(spark, out).select("idx", "loss"), "loss")


@query(f"with {SCORES} select idx, round(diff, 6) as diff from r where rank < floor(0.5 * total)")
def diff_sample_select(spark, sf_dir):
    return rounded(selection.top_fraction(scored(spark, sf_dir), "diff", 0.5).select("idx", "diff"), "diff")


@query(f"with {SCORES} select idx, round(large, 6) as large, round(small, 6) as small, round(diff, 6) as diff from s")
def difference_scores(spark, sf_dir):
    s = scored(spark, sf_dir)
    return rounded(selection.difference(s.select("idx", F.col("large").alias("score")), s.select("idx", F.col("small").alias("score"))), "large", "small", "diff")


@query(f"with {SCORES} select count(diff) as n, round(avg(diff), 6) as mean, round(max(diff), 6) as highest, round(min(diff), 6) as lowest, 0::bigint as nans from s")
def score_stats(spark, sf_dir):
    return rounded(selection.stats(scored(spark, sf_dir), "diff"), "mean", "highest", "lowest")


@query("""with s as (select cast(length(text) as double) as v from documents), g as (select min(v) as lo, max(v) as hi, count(*) as total from s),
b as (select least(cast(floor((v - lo) / ((hi - lo) / 100)) as bigint), 99) as bin, count(*) as n, any_value(total) as total, any_value((hi - lo) / 100) as width from s, g group by 1)
select bin, n, round(n / (total * width), 9) as density, round(sum(n) over (order by bin) / total, 6) as cumulative from b""")
def score_histogram(spark, sf_dir):
    v = table(spark, sf_dir, "documents").select(F.length("text").cast("double").alias("v"))
    h = selection.histogram(v, "v", 100)
    return rounded(rounded(h, "cumulative"), "density", digits=9)


@query(f"with {SCORES} select idx, cast(rank as bigint) as rank from r")
def score_ranks(spark, sf_dir):
    return selection.ranked(scored(spark, sf_dir), "diff").select("idx", F.col("rank").cast("long").alias("rank"))


@query(f"with {SCORES} select * from (select idx, cast(rank as bigint) as place, 'top' as side from r where rank < 100 union all select idx, cast(rank - total + 100 as bigint), 'bottom' from r where rank >= total - 100)")
def top_and_bottom(spark, sf_dir):
    s = scored(spark, sf_dir)
    sides = [selection.top(s, "diff", 100, lowest=low).select("idx", F.col("place").cast("long").alias("place"), F.lit(name).alias("side")) for name, low in (("top", False), ("bottom", True))]
    return sides[0].union(sides[1])


def _report_sql() -> str:
    parts = ["select 'top' as report, idx from r where rank < 1000", "select 'bottom', idx from r where rank >= total - 1000"]
    for f in (0.001, 0.01, 0.1):
        for name, where in ((f"top_{f:g}", f"rank < floor({f}::double * total)"), (f"bottom_{f:g}", f"rank >= total - floor({f}::double * total)")):
            parts.append(f"select * from (select '{name}', idx from r where {where} order by md5('42:' || idx), idx limit 1000)")
    return " union all ".join(parts)


@query(f"with {SCORES} {_report_sql()}")
def score_reports(spark, sf_dir):
    return selection.reports(scored(spark, sf_dir), "diff").select("report", "idx")


@query(f"""with {SCORES}, p as ({_report_sql()})
select report, idx, round(large, 6) as large, round(small, 6) as small, round(diff, 6) as value, source from p join s using (idx) join documents on doc_id = idx""")
def report_lookup(spark, sf_dir):
    scores, docs = scored(spark, sf_dir), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), "source")
    return rounded(selection.report_rows(selection.reports(scores, "diff"), scores, docs), "value", "large", "small")


@query("select doc_id as idx from documents order by md5('42:' || doc_id), doc_id limit 64")
def audit_sample(spark, sf_dir):
    return selection.sample_rows(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx")), 64)


@query("select doc_id as idx from documents where doc_id not in (select doc_id from labels)")
def rows_not_done(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"))
    return selection.not_done(docs, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("idx")))


@query(f"with {SCORES} select l.quality, count(*) as n, sum(case when rank < floor(0.5 * total) then 1 else 0 end)::bigint as kept from r join labels l on l.doc_id = idx group by 1")
def selection_by_quality(spark, sf_dir):
    s = scored(spark, sf_dir)
    n = s.count()
    ranked = selection.ranked(s, "diff").join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("idx"), "quality"), "idx")
    return ranked.groupBy("quality").agg(F.count("*").alias("n"), F.sum((F.col("rank") < int(0.5 * n)).cast("long")).alias("kept"))


# Batches


def _arrays(df: DataFrame) -> DataFrame:
    """Arrays as comma-joined text, which every engine hashes alike."""
    return df.select(*(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes))


_J = "array_to_string({}, ',')"
_BATCH = """{j0} as input_ids, {j1} as attention_mask, {j2} as position_ids, {j3} as label, {j4} as loss_mask"""


def _batch_sql(full: str, length: str, mask: str) -> str:
    n = f"greatest(len({full}) - 1, 0)"
    pads = f"list_transform(range({length} - {n}), lambda z: 0)"
    cols = (f"list_concat(({full})[1:{n}], {pads})", f"list_concat(list_transform(range({n}), lambda z: 1), {pads})", f"list_concat(range({n}), {pads})", f"list_concat(({full})[2:{n} + 1], {pads})", f"list_concat({mask}, {pads})")
    return _BATCH.format(**{f"j{i}": _J.format(c) for i, c in enumerate(cols)})


@query(f"with {_LENGTHS}, f as (select idx, t[1:129] as f from l) select idx, {_batch_sql('f', '128', 'list_transform(f[1:greatest(len(f) - 1, 0)], lambda x: case when x <> 46 then 1 else 0 end)')} from f")
def lm_batch(spark, sf_dir):
    b = batching.lm_batch(rows_of(spark, sf_dir), 128, 46)
    # the pad id stands for 0 in the fill, so that masked inputs and fill differ in the digest
    return _arrays(b.select("idx", *(F.expr(f"transform({c}, (x, i) -> if(attention_mask[i] = 0, 0, x))").alias(c) if c in ("input_ids", "label") else F.col(c) for c in b.columns[1:])))


@query(f"with {_LENGTHS} select cast(idx // 16 as bigint) as batch, cast(least(max(n) - 1, 512) as bigint) as width from l group by 1")
def adaptive_width(spark, sf_dir):
    b = batching.lm_batch(rows_of(spark, sf_dir), 512, 46, batch=F.floor(F.col("idx") / 16))
    return b.groupBy(F.floor(F.col("idx") / 16).alias("batch")).agg(F.max(F.size("input_ids")).cast("long").alias("width"))


_PROMPTS = f"""c as (select conv_id * 100 + turn as idx, {IDS} as t from conversations),
pr as (select idx, t[1:least(len(t), 20)] as prompt, t[21:] as response from c),
tr as (select idx, case when len(prompt) + len(response) > 65 then prompt[greatest(len(prompt) - 15, 1):] else prompt end as p, prompt, response from pr),
tt as (select idx, p as prompt, case when len(prompt) + len(response) > 65 then response[1:greatest(65 - len(p), 0)] else response end as response from tr)"""


def prompts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ids_of(X.tokenize(F.col("text")))
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("idx"), t.alias("t"))
    marked = rows.select("idx", F.concat(F.slice("t", 1, 20), F.array(F.lit(-1)), F.slice("t", F.lit(21), F.greatest(F.size("t") - 20, F.lit(0)))).alias("tokens"))
    return batching.truncate_prompt(batching.split_prompt(marked, -1), 64, 16)


@query(f"with {_PROMPTS} select idx, cast(len(prompt) as int) as n_prompt, cast(len(response) as int) as n_response, array_to_string(list_concat(prompt, response), ',') as ids from tt")
def prompt_rows(spark, sf_dir):
    p = prompts_of(spark, sf_dir)
    return p.select("idx", F.size("prompt").alias("n_prompt"), F.size("response").alias("n_response"), F.array_join(F.concat("prompt", "response").cast("array<string>"), ",").alias("ids"))


@query(f"with {_PROMPTS}, f as (select idx, prompt, list_concat(prompt, response)[1:65] as f from tt) select idx, {_batch_sql('f', '64', 'list_transform(range(greatest(len(f) - 1, 0)), lambda i: case when i >= len(prompt) - 1 and f[i + 1] <> 0 then 1 else 0 end)')} from f")
def prompt_batch(spark, sf_dir):
    return _arrays(batching.prompt_batch(prompts_of(spark, sf_dir), 64, 0))


@query(f"""with {_PROMPTS}, g as (select *, max(len(prompt)) over w as mp, max(len(response)) over w as mr from tt window w as (partition by idx // 800))
select idx, array_to_string(list_concat(list_transform(range(mp - len(prompt)), lambda z: 0), prompt), ',') as input_ids,
array_to_string(list_concat(list_transform(range(mp - len(prompt)), lambda z: 0), list_transform(range(len(prompt)), lambda z: 1)), ',') as attention_mask,
array_to_string(list_concat(response, list_transform(range(mr - len(response)), lambda z: 0)), ',') as rest_ids from g""")
def generation_batch(spark, sf_dir):
    p = prompts_of(spark, sf_dir).withColumnRenamed("response", "rest")
    return _arrays(batching.lm_batch_gen(p, 0, F.floor(F.col("idx") / 800)))


@query(f"with {_PROMPTS}, z as (select idx, unnest(range(len(t) - 1)) as pos, t from c where len(t) > 1) select idx, cast(pos as int) as pos, t[pos + 1] as token, t[pos + 2] as next from z")
def next_token_rows(spark, sf_dir):
    t = ids_of(X.tokenize(F.col("text")))
    return batching.next_tokens(table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("idx"), t.alias("tokens")))


_ORDER = "o as (select epoch, doc_id as idx, row_number() over (partition by epoch order by md5('1234:' || epoch || ':' || doc_id), doc_id) - 1 as pos from documents, (select unnest(range(3)) as epoch))"


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.order_matrix(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx")), 3)


@query(f"with {_ORDER} select cast(epoch as int) as epoch, cast(pos as bigint) as pos, idx from o")
def data_order(spark, sf_dir):
    return orders(spark, sf_dir).select(F.col("epoch").cast("int").alias("epoch"), F.col("pos").cast("long").alias("pos"), "idx")


@query(f"with {_ORDER} select cast(epoch as int) as epoch, cast(pos as bigint) as pos, source from o join documents on doc_id = idx where (epoch, pos) >= (1, 77)")
def resumed_order(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), "source")
    kept = batching.not_skipped(orders(spark, sf_dir).withColumn("epoch", F.col("epoch").cast("int")).withColumn("pos", F.col("pos").cast("long")), 1, 77)
    return batching.in_order(kept, docs).select("epoch", "pos", "source")


@query(f"with {_ORDER} select cast(epoch as int) as epoch, cast(pos as bigint) as pos, idx from o where (epoch, pos // 64 * 64) >= (1, 77)")
def resumed_batches(spark, sf_dir):
    kept = batching.batches_not_skipped(orders(spark, sf_dir), 1, 77, 64)
    return kept.select(F.col("epoch").cast("int").alias("epoch"), F.col("pos").cast("long").alias("pos"), "idx")


@query(f"with {_SHARDED} select idx, idx // 64 as step from h where idx < (select count(*) // 64 * 64 from h)")
def whole_batches(spark, sf_dir):
    return batching.drop_last(sharded(spark, sf_dir).select("idx"), 64, "idx").select("idx", F.col("step").cast("long").alias("step"))


@query(f"with {_SHARDED} select idx, cast(idx % 8 as int) as worker, idx // 8 as turn from h")
def worker_rows(spark, sf_dir):
    return batching.to_workers(sharded(spark, sf_dir).select("idx"), 8).withColumn("turn", F.col("turn").cast("long"))


@query(f"""with {_LENGTHS}, z as (select idx, t, list_position(list_transform(list_reverse(t), lambda x: x <> 46), true) as after from l)
select idx, array_to_string(case when coalesce(after, 0) = 0 then t else t[1:len(t) - after + 1] end, ',') as t, cast(len(list_filter(t, lambda x: x = 46)) + 1 as int) as parts from z""")
def whole_trimmed_and_split(spark, sf_dir):
    t = rows_of(spark, sf_dir)
    return _arrays(t.select("idx", X.trim_pads(F.col("tokens"), 46).alias("t"), F.size(X.split_array(F.col("tokens"), 46)).alias("parts")))


# Files: written to the shared folder and read back


def shards_on_disk(spark: SparkSession, sf_dir: str) -> str:
    """Where the documents' tokens have been written as shards."""
    rows = table(spark, sf_dir, "documents").select("doc_id", ids_of(X.tokenize(F.col("text"))).cast("array<bigint>").alias("tokens"))
    path = new_path(spark, "shards")
    binidx.save(sequences.into_shards(rows, ["doc_id"], SHARD).select("shard", "local_idx", "tokens"), path)
    return path


def digests(stored_rows: DataFrame) -> DataFrame:
    return stored_rows.select("idx", "shard", "local_idx", F.size("tokens").alias("n_tokens"), F.md5(F.array_join(F.col("tokens").cast("array<string>"), ",")).alias("digest"))


_STORED = f"{_SHARDED}, {_LENGTHS}, r as (select h.idx, doc_id, shard, local_idx, cast(n as int) as n_tokens, md5(coalesce(array_to_string(t, ','), '')) as digest from h join l on l.idx = h.doc_id)"


@query(f"with {_STORED} select idx, shard, local_idx, n_tokens, digest from r")
def shard_files(spark, sf_dir):
    return digests(binidx.load(spark, shards_on_disk(spark, sf_dir)))


@query(f"with {_STORED} select idx, shard, local_idx, n_tokens, digest from r where idx in (select doc_id from labels)")
def stored_rows_by_id(spark, sf_dir):
    """The stored sequences that a table of ids names, fetched without reading the others."""
    ids = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("idx"))
    return digests(binidx.fetch(ids, shards_on_disk(spark, sf_dir)))


@query(f"with {_STORED}, n as (select count(*) as n from r) select case when idx < n * 8 // 10 then 'train' when idx < n * 9 // 10 then 'dev' else 'test' end as role, idx, shard, n_tokens, digest from r, n")
def rows_by_role(spark, sf_dir):
    """Training, development and test rows as ranges of the stored shards; each reads its own rows alone."""
    path = shards_on_disk(spark, sf_dir)
    n = binidx.manifest(spark, path).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = [digests(rows).select(F.lit(role).alias("role"), "idx", "shard", "n_tokens", "digest") for role, rows in sequences.by_role(lambda chosen: binidx.where(spark, path, chosen), n).items()]
    return parts[0].union(parts[1]).union(parts[2])


@query(f"with {_STORED} select idx, cast(shard // 2 as int) as shard, cast(idx % {2 * SHARD} as int) as local_idx, n_tokens, digest from r")
def merged_shards(spark, sf_dir):
    """Two stored shards joined into one each, without decoding them."""
    path = new_path(spark, "merged")
    binidx.merge(spark, [(shards_on_disk(spark, sf_dir), "data")], path, per_shard=2)
    return digests(binidx.load(spark, path))


@query(f"with {_STORED} select idx, shard, local_idx, n_tokens, digest from r")
def streamed_shards(spark, sf_dir):
    """The stored rows as a stream of micro-batches, collected in a table: of two shards each, or of a 16th of the rows if
    that is more, as each batch has its own cost."""
    path, out, mark = shards_on_disk(spark, sf_dir), new_path(spark, "streamed"), new_path(spark, "mark")
    n = binidx.manifest(spark, path).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    incremental.shards_to_table(spark, path, out, mark, per_batch=max(2 * SHARD, -(-n // 16)))
    return digests(spark.read.schema(binidx.SCHEMA).parquet(out))


def _mixed_sql(value: str) -> str:
    """The round function of operators.shuffle in SQL."""
    p = "2147483647"
    x = f"(({value} * 1103515245 + (1234 * 1000003 + epoch * 7919) % {p} + (k % 6) * 104729) % {p})"
    x = f"((xor({x}, {x} >> 15) * 48271) % {p})"
    return f"((xor({x}, {x} >> 13) * 69621) % {p})"


_PLACES = f"""z as (select n, a, (n + a - 1) // a as b from (select n, case when s * s >= n then s when (s + 1) * (s + 1) >= n then s + 1 else s + 2 end as a from (select count(*) as n, greatest(1, cast(floor(sqrt(count(*))) as bigint) - 1) as s from documents))),
s as (select epoch, idx, idx // b as l, idx % b as r, 0 as k from (select unnest(range(3)) as epoch), (select row_number() over () - 1 as idx from documents), z
  union all select epoch, idx, case when k % 2 = 0 then (l + {_mixed_sql("r")}) % a else l end, case when k % 2 = 1 then (r + {_mixed_sql("l")}) % b else r end, k + 1 from s, z where k = 0 or k % 6 <> 0 or l * b + r >= n),
o as (select cast(epoch as int) as epoch, l * b + r as pos, idx from s, z where k > 0 and k % 6 = 0 and l * b + r < n)"""


@query(f"with recursive {_PLACES} select epoch, pos, idx from o")
def arithmetic_order(spark, sf_dir):
    """Each stored row's place in three epochs, computed from its number."""
    path = shards_on_disk(spark, sf_dir)
    n = binidx.manifest(spark, path).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return shuffle.in_epochs(binidx.load(spark, path).select("idx"), n, 3).select("epoch", "pos", "idx")


@query(f"with recursive {_PLACES}, {_STORED} select epoch, pos, idx, n_tokens, digest from o join r using (idx) where (epoch, pos) >= (1, 77)")
def resumed_arithmetic_order(spark, sf_dir):
    """The rows that a run which stopped at (1, 77) has yet to see, fetched from the shards by their numbers."""
    path = shards_on_disk(spark, sf_dir)
    n = binidx.manifest(spark, path).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    order = shuffle.rows_from(spark, n, 3, 1, 77)
    return order.join(digests(binidx.fetch(order.select("idx"), path)).select("idx", "n_tokens", "digest"), "idx").select("epoch", "pos", "idx", "n_tokens", "digest")


@query("select source as domain, count(*) as docs, cast(sum(length(text)) as bigint) as chars, min(md5(text)) as least, max(md5(text)) as most from documents group by 1")
def json_lines(spark, sf_dir):
    path = new_path(spark, "corpus")
    files.write_corpus(table(spark, sf_dir, "documents"), path, per_file=100)
    docs = files.corpus(spark, path)
    return docs.groupBy("domain").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"), F.min(F.md5("text")).alias("least"), F.max(F.md5("text")).alias("most"))


def source_parts(spark: SparkSession, sf_dir: str) -> list[str]:
    """The documents as JSON lines, a part for each source, in the seeded order of the parts' names."""
    path = new_path(spark, "parts")
    docs = table(spark, sf_dir, "documents")
    docs.select("text", F.struct(F.col("source").alias("pile_set_name")).alias("meta"), F.concat(F.lit("of-"), "source").alias("part")).write.partitionBy("part").json(path)
    return files.file_list(spark, path)


_PARTS = "p as (select source, count(*) as docs, sum(length(text))::bigint as chars, row_number() over (order by md5('233:part=of-' || source)) - 1 as place from documents group by source)"


@query(f"with {_PARTS} select case when place < 2 then 'first' when place < 5 then 'second' else 'rest' end as part, cast(place as int) as place, source as domain, docs, chars from p")
def file_ranges(spark, sf_dir):
    """An ordered list of files in three ranges, as workers would take them; a range opens its own files alone."""
    parts = source_parts(spark, sf_dir)
    ranges = (("first", 0, 2), ("second", 2, 5), ("rest", 5, None))
    each = [files.corpus_of(spark, parts, a, b).select(F.lit(name).alias("part"), "place", "domain", "text") for name, a, b in ranges]
    return each[0].union(each[1]).union(each[2]).groupBy("part", "place", "domain").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"))


@query(f"with {_PARTS}, s as (select *, coalesce(sum(docs) over (order by place rows between unbounded preceding and 1 preceding), 0) as before, sum(docs) over () as total from p) select cast(place as int) as place, source as domain, docs from s where before < total * 2 // 5")
def files_until_enough(spark, sf_dir):
    """Files in their order until they hold two fifths of the documents, as many shards as are wanted; the rest stays closed."""
    parts = source_parts(spark, sf_dir)
    n, _ = files.enough_parts(spark, parts, table(spark, sf_dir, "documents").count() * 2 // 5)
    return files.corpus_of(spark, parts, 0, n).groupBy("place", "domain").agg(F.count("*").alias("docs"))


@query("select count(*) as n, min(i) as low, max(i) as high, count(distinct i) as ids from (select row_number() over (order by doc_id) - 1 as i from documents)")
def numbered_lines(spark, sf_dir):
    path = new_path(spark, "corpus")
    files.write_corpus(table(spark, sf_dir, "documents"), path, per_file=100)
    ids = files.numbered(files.corpus(spark, path))
    return ids.agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count_distinct("doc_id").alias("ids"))


@query("select event_id as idx, cast(event_id // 1000 as int) as file_id, row_number() over (order by event_id // 1000, event_id) - 1 as place, round(value, 6) as score from events")
def score_files(spark, sf_dir):
    path = new_path(spark, "scores")
    e = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 1000).cast("int").alias("file_id"), F.col("event_id").alias("pos"), F.col("value").alias("score"))
    files.write_scores(e, path)
    return rounded(row_number(files.scores(spark, path), ["file_id", "pos"], "place").select(F.col("pos").alias("idx"), "file_id", "place", "score"), "score")


@query("select event_id as idx, user_id, round(value, 6) as score from events")
def scores_of_dataset(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("event_id").alias("idx"), "user_id")
    return rounded(selection.against_dataset(rows, e.select(F.col("event_id").alias("idx"), F.col("value").alias("score"))), "score")


@query("""with f as (select distinct 'scores_' || (event_id // 1000) as name, event_id // 1000 as number from events)
select name, cast(number as int) as number, cast(row_number() over (order by number, name) - 1 as int) as place from f""")
def score_file_order(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("scores_"), F.floor(F.col("event_id") / 1000).cast("string")).alias("name")).distinct()
    return files.manifest_of_names(e)


def _characters():
    return (lambda ids: "".join(map(chr, ids))), (lambda text: [ord(c) + 3 for c in text])


@query(f"with {_LENGTHS}, z as (select idx, list_transform(t, lambda x: case when x = 46 then 2 else x + 3 end)[1:64] as t from l) select idx, array_to_string(case when len(t) > 1 then t else list_append(t, 2) end, ',') as t from z")
def retokenized_rows(spark, sf_dir):
    out = retokenize.retokenize(rows_of(spark, sf_dir), _characters, old_eos=46, new_eos=2, length=64)
    return out.select("idx", F.array_join(F.col("tokens").cast("array<string>"), ",").alias("t"))


# Distributions and losses: an embedding's elements are the logits of one position.


_PROBS = """v as (select vec_id, embedding as e, list_max(embedding)::double as m from embeddings),
x as (select vec_id as idx, 0 as pos, unnest(range(len(e))) as token_id, e, m from v),
y as (select idx, pos, token_id, exp((e[token_id + 1]::double - m) / 1.0) as ex, e[token_id + 1]::double - m as d from x),
p as (select idx, pos, token_id, ex / sum(ex) over (partition by idx) as p, d - ln(sum(ex) over (partition by idx)) as logp from y)"""


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), F.lit(0).alias("pos"), X.softmax(F.col("embedding")).alias("p"), X.log_softmax(F.col("embedding")).alias("l"))
    return e.select("idx", "pos", F.posexplode(F.arrays_zip("p", "l")).alias("token_id", "e")).select("idx", "pos", "token_id", F.col("e.p").alias("p"), F.col("e.l").alias("logp"))


@query(f"with {_PROBS} select idx, cast(token_id as int) as token_id, round(p, 9) as p, round(logp, 6) as logp from p")
def softmax_rows(spark, sf_dir):
    return rounded(rounded(probabilities(spark, sf_dir).select("idx", "token_id", "p", "logp"), "logp"), "p", digits=9)


@query("""with v as (select vec_id, embedding as e, list_max(embedding)::double as m from embeddings),
x as (select vec_id, unnest(list_transform(e, lambda z: exp((z::double - m) / 0.7))) as ex from v)
select vec_id as idx, round(max(ex) / sum(ex), 9) as top from x group by 1""")
def temperature_softmax(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), F.array_max(X.softmax(F.col("embedding"), 0.7)).alias("top"))
    return rounded(e, "top", digits=9)


@query(f"with {_PROBS} select idx, cast(token_id as int) as token_id, cast(row_number() over (partition by idx order by round(p, 12) desc, token_id) as int) as rank from p qualify rank <= 5")
def top_k_tokens(spark, sf_dir):
    return sparse_rows(spark, sf_dir).select("idx", F.posexplode("entries").alias("rank", "e")).select("idx", F.col("e.token_id").alias("token_id"), (F.col("rank") + 1).alias("rank"))


def sparse_rows(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """idx, pos, entries: the k likeliest tokens of each position, ties after rounding to the lower id."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), F.lit(0).alias("pos"), X.softmax(F.col("embedding")).alias("p"))
    order = F.transform(distill.top_k_of_array(F.transform("p", lambda x: F.round(x, 12)), k), lambda t: F.struct(t["token_id"].alias("token_id"), F.get("p", t["token_id"]).alias("p")))
    return e.select("idx", "pos", order.alias("entries"))


@query(f"with {_PROBS} select idx, round(sum(p), 9) as mass from (select *, row_number() over (partition by idx order by round(p, 12) desc, token_id) as k from p) where k <= 5 group by idx")
def top_k_mass(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), distill.top_k_of_array(X.softmax(F.col("embedding")), 5).alias("t"))
    return rounded(e.select("idx", F.aggregate("t", F.lit(0.0), lambda a, x: a + x["p"]).alias("mass")), "mass", digits=9)


_KD = f"""{_PROBS}, t5 as (select * from (select *, row_number() over (partition by idx order by round(p, 12) desc, token_id) as k from p) where k <= 5),
st as (select idx, token_id, logp as lq from p),
pairs as (select a.idx, a.token_id, a.p, a.logp, b.lq from t5 a join st b on b.idx = (a.idx + 1) % (select count(*) from embeddings) and b.token_id = a.token_id),
kd as (select idx, -sum(p * lq) as kd, -sum(p * logp) as ent from pairs group by idx)"""


@query(f"with {_KD} select idx, round(kd, 6) as kd, round(ent, 6) as entropy, round(0.5 * ent + 0.5 * kd, 6) as blended from kd")
def distillation_losses(spark, sf_dir):
    return rounded(distilled(spark, sf_dir), "kd", "entropy", "blended")


def distilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's teacher against the student that the next row is, in turn."""
    rows = table(spark, sf_dir, "embeddings")
    n = rows.count()
    teacher = sparse_rows(spark, sf_dir)
    student = rows.select(F.pmod(F.col("vec_id") - 1, F.lit(n)).alias("idx"), F.lit(0).alias("pos"), X.log_softmax(F.col("embedding")).alias("logq"))
    mask = teacher.select("idx", "pos", F.lit(1).alias("mask"))
    both = distill.kd_losses_of_rows(teacher, student, mask)
    return both.withColumn("blended", distill.blended(F.col("entropy"), F.col("kd")))


@query(f"with {_KD} select round(avg(kd), 6) as kd, round(avg(ent), 6) as entropy, count(*) as n from kd")
def distillation_means(spark, sf_dir):
    return rounded(distilled(spark, sf_dir).agg(F.avg("kd").alias("kd"), F.avg("entropy").alias("entropy"), F.count("*").alias("n")), "kd", "entropy")


@query(f"""with {_KD}, lab as (select idx, idx % (select max(len(embedding)) from embeddings) as label, (idx + 1) % (select count(*) from embeddings) as student from kd),
ce as (select lab.idx, -t.logp as teacher, -s.logp as lm from lab join p t on t.idx = lab.idx and t.token_id = label join p s on s.idx = student and s.token_id = label)
select round(avg(0.5 * lm + 0.5 * kd), 6) as loss, round(avg(lm), 6) as lm_loss, round(avg(kd), 6) as kd_loss, round(avg(ent), 6) as kd_entropy, round(avg(teacher), 6) as teacher_loss from ce join kd using (idx)""")
def distillation_evaluation(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    size = rows.agg(F.count("*"), F.max(F.size("embedding"))).first()
    label = F.pmod(F.col("idx"), F.lit(size[1])).cast("int")
    teacher = rows.select(F.col("vec_id").alias("idx"), "embedding").select("idx", distill.cross_entropy(F.col("embedding"), label).alias("teacher"))
    student = rows.select(F.pmod(F.col("vec_id") - 1, F.lit(size[0])).alias("idx"), "embedding").select("idx", distill.cross_entropy(F.col("embedding"), label).alias("lm"))
    losses = distilled(spark, sf_dir).join(teacher, "idx").join(student, "idx")
    return rounded(distill.eval_means(losses), "loss", "lm_loss", "kd_loss", "kd_entropy", "teacher_loss")


@query(f"with {_PROBS} select idx, round(-logp, 6) as loss from p where token_id = idx % (select max(len(embedding)) from embeddings)")
def token_cross_entropy(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), "embedding")
    return rounded(e.select("idx", distill.cross_entropy(F.col("embedding"), F.col("idx") % F.size("embedding")).alias("loss")), "loss")


@query(f"""with {_PROBS}, q as (select idx, token_id, sum(p) over (partition by idx order by token_id) as upto, sum(p) over (partition by idx) as total from p),
u as (select vec_id as idx, j, ('0x' || substr(md5('42:' || vec_id || ':0:' || j), 1, 13))::bigint / 4503599627370496.0::double as u from embeddings, (select unnest(range(50)) as j)),
d as (select u.idx, j, least(count(*) filter (where upto <= u * total), max(token_id)) as token_id from u join q using (idx) group by u.idx, j)
select idx, cast(token_id as int) as token_id, cast(count(*) as int) as count from d group by 1, 2""")
def drawn_token_counts(spark, sf_dir):
    dense = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), F.lit(0).alias("pos"), X.softmax(F.col("embedding")).alias("p"))
    return distill.draw(dense, 50).select("idx", "token_id", "count")


@query(f"with {_KD}, f as (select idx, cast(cast(p as float) as double) as p, lq from pairs) select idx, round(-sum(p * lq), 6) as kd, round(-sum(p * ln(p)), 6) as entropy from f group by idx")
def offline_losses(spark, sf_dir):
    """Losses against a written cache of floats, which meets the student's rows bucket by bucket."""
    rows = table(spark, sf_dir, "embeddings")
    n = rows.count()
    entries = sparse_rows(spark, sf_dir).select("idx", "pos", F.explode("entries").alias("e")).select("idx", "pos", "e.*")
    cache = distill.co_located(distill.to_cache(entries, 64), "cache", 16)
    student = rows.select(F.pmod(F.col("vec_id") - 1, F.lit(n)).alias("idx"), F.array(X.log_softmax(F.col("embedding"))).alias("logq"), F.array(F.lit(1)).alias("mask"))
    losses = distill.cached_losses(cache, distill.co_located(student, "student", 16))
    return rounded(losses, "kd", "entropy")


@query(f"with {_KD} select idx, cast(idx // 64 as int) as shard_id, cast(token_id as int) as token_id, round(cast(cast(p as float) as double), 6) as p from t5")
def sparse_cache(spark, sf_dir):
    entries = sparse_rows(spark, sf_dir).select("idx", "pos", F.explode("entries").alias("e")).select("idx", "pos", "e.*")
    path = new_path(spark, "cache")
    distill.write_cache(distill.to_cache(entries, 64), path)
    cache = spark.read.parquet(path)
    back = distill.from_cache(cache).join(cache.select("idx", "shard_id"), "idx")
    return rounded(back.select("idx", "shard_id", "token_id", "p"), "p")


@query(f"with {_KD}, n as (select max(len(embedding)) as n from embeddings) select idx, cast(max(n) as int) as size, count(*) as filled, round(sum(p * token_id), 6) as moment from t5, n group by idx")
def scattered_rows(spark, sf_dir):
    n = table(spark, sf_dir, "embeddings").agg(F.max(F.size("embedding"))).first()[0]
    dense = sparse_rows(spark, sf_dir).select("idx", distill.to_dense(F.col("entries"), n or 1).alias("d"))
    moment = F.aggregate(F.transform("d", lambda p, i: p * i), F.lit(0.0), lambda s, x: s + x)
    return rounded(dense.select("idx", F.size("d").alias("size"), F.size(F.filter("d", lambda p: p > 0)).cast("long").alias("filled"), moment.alias("moment")), "moment")


@query(f"with {_KD} select idx, cast(token_id as int) as token_id from t5 where idx % 3 > 0")
def entries_within_length(spark, sf_dir):
    entries = sparse_rows(spark, sf_dir).select("idx", "pos", F.explode("entries").alias("e")).select("idx", "pos", "e.*")
    lengths = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), (F.col("vec_id") % 3).alias("length"))
    return distill.valid(entries, lengths).select("idx", "token_id")


_LOSSES = "z as (select user_id as idx, event_id as pos, value as loss, case when event_type = 'click' then 0 else 1 end as mask from events)"


def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("idx"), F.col("event_id").alias("pos"), F.col("value").alias("loss"), F.when(F.col("event_type") == "click", 0).otherwise(1).alias("mask"))


@query(f"with {_LOSSES} select idx, round(sum(loss * mask) / nullif(sum(mask), 0), 6) as mean from z group by idx")
def masked_means(spark, sf_dir):
    return rounded(distill.masked_mean(losses(spark, sf_dir)), "mean")


@query(f"with {_LOSSES}, m as (select idx, sum(loss * mask) / nullif(sum(mask), 0) as mean from z group by idx) select round(avg(mean), 6) as mean, count(*) as n from m")
def dataset_loss(spark, sf_dir):
    return rounded(evaluation.dataset_mean(distill.masked_mean(losses(spark, sf_dir)).withColumnRenamed("mean", "loss")), "mean")


# Evaluation and logs


@query("select event_type as name, event_id // 500 as window, round(avg(value), 6) as mean, count(*) as n from events group by 1, 2")
def log_windows(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), F.col("event_type").alias("name"), "value")
    return rounded(evaluation.log_windows(log, 500).withColumn("window", F.col("window").cast("long")), "mean")


@query("""with m as (select event_id // 500 as step, event_type as name, avg(value) as v from events group by 1, 2)
select step, string_agg(name || ': ' || printf('%.4f', v), ' | ' order by name) as line from m group by 1""")
def log_lines(spark, sf_dir):
    log = table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 500).alias("step"), F.col("event_type").alias("name")).agg(evaluation.ordered_mean("value", "event_id").alias("value"))
    return evaluation.log_lines(log)


@query("select conv_id, turn, case when turn % 2 = 0 then 'side' else text end as answer from conversations")
def sidecar_answers(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("idx", F.struct("conv_id", "turn"))
    side = c.filter(F.col("turn") % 2 == 0).select("idx", F.array(F.lit("side")).alias("output"))
    out = evaluation.answers(c.select("idx", F.array("text").alias("output")), side)
    return out.select("idx.conv_id", "idx.turn", F.get("output", F.lit(0)).alias("answer"))


_TASKS = "t as (select event_type as task, avg(case when event_id % 2 = 0 then value end) as acc, avg(case when event_type <> 'click' then value end) as acc_norm from events group by 1)"


@query(f"with {_TASKS}, c as (select task, coalesce(acc_norm, acc) as a from t) select task, round(a, 6) as accuracy from c union all select 'avg', round(avg(a), 6) from c")
def macro_average(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("task")).agg(F.avg(F.when(F.col("event_id") % 2 == 0, F.col("value"))).alias("acc"), F.avg(F.when(F.col("event_type") != "click", F.col("value"))).alias("acc_norm"))
    return rounded(evaluation.macro_average(e), "accuracy")


@query("""select event_id, step, round(case when step < 100 then 0.001 * step / 100 else 0.00001 + 0.00099 * 0.5 * (1 + cos(pi() * (step - 100) / 900.0)) end, 12) as cosine,
round(case when step < 100 then 0.001 * step / 100 else 0.001 * (1 - (step - 100) / 900.0) end, 12) as linear,
round(case when step < 100 then 0.001 * step / 100 else 0.001 end, 12) as constant,
round(case when step < 100 then 0.001 * step / 100 else (0.001 - 0.0000001) * pow(1 - (step - 100) / 900.0, 0.5) + 0.0000001 end, 12) as noam
from (select event_id, event_id % 1001 as step from events)""")
def rates_at_events(spark, sf_dir):
    """The learning rates of each event's step, a thousand steps and one to a run."""
    s, steps = F.col("step"), table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 1001).alias("step"))
    out = steps.select("event_id", "step", schedules.cosine(s, 0.001, 0.00001, 1000, 100).alias("cosine"), schedules.linear(s, 0.001, 0.0, 1000, 100).alias("linear"), schedules.constant(s, 0.001, 100).alias("constant"), schedules.polynomial(s, 0.001, 1e-7, 1000, 100).alias("noam"))
    return rounded(out, "cosine", "linear", "constant", "noam", digits=12)


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), F.col("event_type").alias("name"), "value")


@query("""with e as (select greatest(ceil(event_id / 500.0) * 500, 500)::bigint as step, event_type as name, value from events)
select step, name, round(avg(value), 6) as mean, count(*) as n from e where step <= (select max(event_id) from events) group by all""")
def metrics_at_checkpoints(spark, sf_dir):
    return rounded(evaluation.at_checkpoints(event_log(spark, sf_dir), 500), "mean")


@query("""select event_id // 500 as step, event_type as name, count(*) as preds, round(avg(value), 6) as mean from events group by all""")
def evaluation_outputs(spark, sf_dir):
    """Predictions and results of each step, written in folders of their own and read back."""
    preds = event_log(spark, sf_dir).withColumn("step", F.floor(F.col("step") / 500))
    path = new_path(spark, "evals")
    evaluation.write_evals(preds, preds.groupBy("step", "name").agg(F.avg("value").alias("mean")), path)
    preds, results = evaluation.read_evals(spark, path)
    counts = preds.groupBy("step", "name").agg(F.count("*").alias("preds"))
    return rounded(counts.join(results, ["step", "name"]).select(F.col("step").cast("long").alias("step"), "name", "preds", "mean"), "mean")


@query(f"select token, max_by(text, idx) as answer from (select conv_id * 1000 + turn as idx, text, {TOKENS}[1] as token from conversations) where token is not null group by token")
def answer_labels(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    rows = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("idx"), F.array("text").alias("output"))
    return evaluation.label_map(rows, F.get(X.tokenize(F.col("answer")), F.lit(0)))


@query(f"""with {SCORES}, p as ({_report_sql()}), t as (select p.report, idx, printf('##### %s | idx %d | score %.4f #####', p.report, idx, diff) || chr(10) || text || chr(10) as line from p join s using (idx) join documents on doc_id = idx where text is not null)
select report, count(*) as n, md5(string_agg(md5(line), '' order by idx, md5(line))) as digest from t group by report""")
def report_texts(spark, sf_dir):
    """The reports as blocks of text; a digest of each report's blocks."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), "text")
    lines = selection.report_lines(selection.reports(scored(spark, sf_dir), "diff"), docs.filter("text is not null"))
    parts = lines.select(F.regexp_extract("value", r"^##### (\S+) \|", 1).alias("report"), F.regexp_extract("value", r"\| idx (\d+) \|", 1).cast("long").alias("idx"), F.md5("value").alias("m"))
    return parts.groupBy("report").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("idx", "m"))).alias("_l")).select("report", "n", F.md5(F.array_join(F.transform("_l", lambda x: x["m"]), "")).alias("digest"))


@query(r"select conv_id, turn, replace(trim(regexp_replace(text, '\s+$|^\s+', '', 'g')), 'a', chr(10)) as prompt from conversations")
def prompt_texts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", X.newlines(X.strip(F.replace("text", F.lit("a"), F.lit("<n>")))).alias("prompt"))


@query("""select doc_id, case when n_chars % 1000000000 = 0 then (n_chars // 1000000000) || 'B' when n_chars % 1000000 = 0 then (n_chars // 1000000) || 'M' when n_chars % 1000 = 0 then (n_chars // 1000) || 'K' else n_chars::varchar end as named from documents""")
def short_numbers(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.numerize(F.col("n_chars")).alias("named"))
