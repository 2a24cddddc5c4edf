"""SpotSigs document fingerprints, with Spark SQL functions alone.

Where common words (anchors) end and content begins, the next content words form a chain; lists and tables have few
such places, so chains can also be taken by their own words' hashes. A text's fingerprint is the
set of its chains' 32-bit hashes. Fingerprints are put into partitions by set length, and two are compared by Jaccard
similarity only if their partitions are near enough for the similarity to reach a floor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.quality import let

#: Common words of English, German, French and Spanish.
ANCHORS = (
    "a", "al", "an", "and", "are", "as", "at", "auf", "aus", "be", "by", "con", "das", "de", "del", "dem", "den",
    "der", "des", "die", "du", "ein", "eine", "el", "en", "es", "est", "et", "for", "from", "have", "il", "im", "in",
    "is", "ist", "it", "la", "las", "le", "les", "los", "mit", "nicht", "not", "of", "on", "or", "para", "por",
    "pour", "que", "qui", "se", "sich", "sie", "that", "the", "this", "to", "un", "una", "und", "une", "von", "was",
    "with", "y", "zu",
)
_MARK = "\x01"
_ANCHOR = " (?:" + "|".join(sorted(ANCHORS, key=lambda w: (w[0], -len(w)))) + ")(?= )"


def content(text: Column) -> Column:
    """Content words in order, lower-cased; those that follow an anchor directly begin with a mark."""
    plain = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    marked = F.regexp_replace(F.regexp_replace(plain, _ANCHOR, " " + _MARK), f"(?: {_MARK})++ ", f" {_MARK}")
    return F.filter(F.split(marked, " "), lambda w: (w != "") & (w != _MARK))


def fingerprint(text: Column, chain: int = 2, rising: bool = False) -> Column:
    """Ascending distinct 32-bit hashes of the chains. A chain at the end of a text may be shorter. A text without
    anchors has a chain at every word; one without words has none.

    rising: besides those after anchors, there is a chain at each word whose hash is not above the next one's, and at
    the last word; none at every word then. Whether such a chain is taken follows from its own words, so what two texts
    share counts alike in both, however many anchors either has.
    """

    def bare(w: Column) -> Column:
        return F.translate(w, _MARK, "")

    def hashed(ws: Column, at: Column) -> Column:
        return F.transform(at, lambda i: F.shiftright(F.xxhash64(*(bare(F.coalesce(F.get(ws, i + j), F.lit(""))) for j in range(chain))), 32).cast("int"))

    def chains(ws: Column) -> Column:
        if rising:
            spots = let(F.transform(ws, lambda w: F.xxhash64(bare(w))), lambda hs: F.transform(ws, lambda w, i: F.when(w.startswith(_MARK) | F.coalesce(F.get(hs, i) <= F.get(hs, i + 1), F.lit(True)), i)))
            return let(F.filter(spots, lambda i: i.isNotNull()), lambda at: hashed(ws, at))
        spots = F.filter(F.transform(ws, lambda w, i: F.when(w.startswith(_MARK), i)), lambda i: i.isNotNull())
        return let(F.when(F.size(spots) > 0, spots).when(F.size(ws) > 0, F.sequence(F.lit(0), F.size(ws) - 1)).otherwise(F.array().cast("array<int>")), lambda at: hashed(ws, at))

    return let(content(text), lambda ws: F.sort_array(F.array_distinct(chains(ws))))


def partition(size: Column, ratio: float = 0.5) -> Column:
    """Length partition of a set: partitions grow by 1 / ratio, so sets in partitions p apart have a similarity below
    ratio ** (p - 1)."""
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / F.log(F.lit(1 / ratio)) + 1e-9).cast("int")


def likeness(a: Column, b: Column, floor: float = 0.0) -> Column:
    """Jaccard similarity of two fingerprints. Two empty ones are alike (1).

    floor: what a caller asks for at least; a pair whose length partitions are so far apart that it cannot reach that
    is 0 without a comparison. At the default every pair has its similarity."""
    shared = F.size(F.array_intersect(a, b))
    exact = let(shared, lambda n: n / (F.size(a) + F.size(b) - n))
    out = F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0)
    if floor > 0:
        apart = F.abs(partition(F.size(a)) - partition(F.size(b)))
        out = out.when(F.pow(F.lit(0.5), apart - 1) < floor, 0.0)
    return out.otherwise(exact).cast("double")


def as_text(fp: Column) -> Column:
    """Hexadecimal, eight digits a hash."""
    return F.array_join(F.transform(fp, lambda h: F.lpad(F.lower(F.hex(h.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most key, by blocks of 64."""
    if len(bounds) <= 64:
        return F.size(F.filter(F.lit(bounds).cast("array<bigint>"), lambda b: b <= key)) if bounds else F.lit(0)
    blocks = [bounds[i : i + 64] for i in range(0, len(bounds), 64)]
    at = F.greatest(F.lit(0), _bucket(key, [b[0] for b in blocks]) - 1)
    return at * 64 + F.size(F.filter(F.get(F.lit(blocks).cast("array<array<bigint>>"), at), lambda b: b <= key))


def with_next(docs: DataFrame, columns: list[str], buckets: int | None = None, add: dict[str, Column] | None = None) -> DataFrame:
    """docs with next_<column> of the document that follows in ascending doc_id (after the last: the first).

    add: columns to compute first, once a row and for the few that go to a second bucket.
    Documents are dealt by quantiles of doc_id; each bucket also gets the first document of the next one. Null doc_ids
    come first, equal ones in order of their text's hash.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 100 * n)).first()[0] if n > 1 else []
    bucket = _bucket(key, sorted(set(cuts or [])))
    firsts = sorted((r[0], r[1]) for r in docs.groupBy(bucket.alias("b")).agg(F.min(key).alias("k")).collect())  # one row a bucket
    rows = [(firsts[(i + 1) % len(firsts)][1], b) for i, (b, _) in enumerate(firsts)]
    ahead = F.broadcast(spark.createDataFrame(rows, "_key long, _bucket int"))
    held = docs.withColumns({"_key": key, "_ghost": F.lit(0)})
    both = held.withColumn("_bucket", bucket).unionByName(held.withColumn("_ghost", F.lit(1)).join(ahead, "_key"))
    both = both.withColumns(add or {})
    order = Window.partitionBy("_bucket").orderBy("_ghost", "_key", F.xxhash64("text"))
    return both.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns)).filter("_ghost = 0").drop("_key", "_ghost", "_bucket")


def edited(text: Column, after: Column) -> Column:
    """text with its last quarter (rounded down, code points) replaced by as many of the first of after, or all."""
    k = F.floor(F.length(text) / 4).cast("int")
    return F.concat(text.substr(F.lit(1), F.length(text) - k), after.substr(F.lit(1), k))


def compare_neighbours(docs: DataFrame, rising: bool = False) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of docs (doc_id, text).

    rising: as in fingerprint(). Null text is empty; a single document is its own next one; an empty table gives an empty table.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(rows, ["text", "fp"], add={"fp": fingerprint(F.col("text"), rising=rising)})
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fp", "next_fp", fingerprint(F.col("edited"), rising=rising).alias("edited_fp"))
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))


def _classes(docs: DataFrame, rising: bool) -> DataFrame:
    """fp, n (chains), c and c2 (hashes that stand for fp) of docs (doc_id, text), with doc_id."""
    fps = docs.select("doc_id", fingerprint(F.coalesce("text", F.lit("")), rising=rising).alias("fp"))
    return fps.withColumns({"n": F.size("fp"), "c": F.xxhash64("fp"), "c2": F.xxhash64(F.lit(1), "fp")})


def _rarest(sets: DataFrame, common: DataFrame, floor: float) -> DataFrame:
    """c, c2, n, h: of each set (c, c2, n, h) the chains that one has to share with a set of likeness floor or more,
    rarest first; common: (h, times). An empty set stands under one chain."""
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "h")))
    room = F.greatest(F.col("n") - F.ceil(F.col("n") * floor - 1e-9) + 1, F.lit(1)).cast("int")
    first = sets.join(common, "h", "left").groupBy("c", "c2", "n").agg(ordered.alias("hs"))
    return first.select("c", "c2", "n", F.explode(F.slice("hs", F.lit(1), room)).alias("e")).select("c", "c2", "n", F.col("e.h").alias("h"))


def search(asked: DataFrame, docs: DataFrame, floor: float = 0.8, rising: bool = False) -> DataFrame:
    """asked_id, found_id, n_found, near: for each row of asked (doc_id, text) every class of docs (doc_id, text) with
    one fingerprint whose likeness to the row's is floor or more (0 < floor < 1); found_id is the class's least doc_id
    and n_found its number of rows.

    asked is a stated set of rows, which meets all of docs. Two sets are compared only if their length partitions, which
    grow by 1 / floor, are neighbours and if they share one of the chains that are rarest in docs; then by Jaccard.
    Copies count as one set. Null text is empty; empty ones are alike; a null doc_id is kept in asked and is a found_id
    only of a class without any other; repeated rows of asked are repeated in the result; other columns are not looked at.
    """
    asking = _classes(asked.select("doc_id", "text"), rising)
    have = _classes(docs.select("doc_id", "text"), rising).groupBy("fp", "n", "c", "c2").agg(F.min("doc_id").alias("found_id"), F.count("*").alias("n_found"))
    chains = F.explode(F.when(F.size("fp") > 0, F.col("fp")).otherwise(F.array(F.lit(0)))).alias("h")
    ours = have.select("c", "c2", "n", chains)
    common = ours.groupBy("h").agg(F.count("*").alias("times"))
    theirs = asking.select("c", "c2", "n", "fp").dropDuplicates(["c", "c2"]).select("c", "c2", "n", chains)
    right = _rarest(ours, common, floor).withColumn("p", partition(F.col("n"), floor))
    left = _rarest(theirs, common, floor).select(F.col("c").alias("q"), F.col("c2").alias("q2"), F.col("n").alias("m"), "h", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda i: partition(F.col("n"), floor) + i)).alias("p"))
    near_enough = F.least("n", "m") >= F.greatest("n", "m") * floor - 1e-9
    pairs = left.join(right, ["h", "p"]).filter(near_enough).select("q", "q2", "c", "c2").distinct()
    sets = asking.select(F.col("c").alias("q"), F.col("c2").alias("q2"), F.col("fp").alias("_fp")).dropDuplicates(["q", "q2"])
    alike = pairs.join(sets, ["q", "q2"]).join(have, ["c", "c2"]).withColumn("near", likeness(F.col("_fp"), F.col("fp"), floor)).filter(F.col("near") >= floor)
    ids = asking.select(F.col("doc_id").alias("asked_id"), F.col("c").alias("q"), F.col("c2").alias("q2"))
    return ids.join(alike.select("q", "q2", "found_id", "n_found", "near"), ["q", "q2"]).select("asked_id", "found_id", "n_found", "near")
