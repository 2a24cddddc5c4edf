"""Corpus building: domains, tokens, end-of-sentence sets, packed sequences."""

from __future__ import annotations

from collections.abc import Generator, Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import tokenize
from millrace.operators.order import prefix_sum, seeded, stored

#: Characters that end a sentence, and bracket pairs that must be closed in a piece.
SENTENCE_ENDS = (".", "!", "?", ";", "\n")
BRACKETS = (("[", "]"), ("(", ")"), ("{", "}"), ("<", ">"))
#: Tokens that a task packs at a time, however long a stream is.
AT_ONCE = 1 << 18
#: Bytes of text that a task cuts into words at a time, and bytes of counts that it adds up before it hands them on.
TEXT_AT_ONCE, COUNTS_AT_ONCE = 1 << 22, 1 << 25
#: What a byte of UTF-8 is to tokenize(): 0 white space, 1 a letter or digit, 2 another character, 3 more of that character.
BYTES = np.full(256, 2, np.uint8)
BYTES[list(b"\t\n\v\f\r ")], BYTES[list(b"abcdefghijklmnopqrstuvwxyz0123456789")], BYTES[0x80:0xC0] = 0, 1, 3


def encode(docs: DataFrame, eos: str = "<eos>") -> DataFrame:
    """doc_id, domain, n_chars, tokens (with the end token) of docs (doc_id, text, source)."""
    return docs.select("doc_id", F.col("source").alias("domain"), F.length("text").cast("long").alias("n_chars"), F.array_append(tokenize(F.col("text")), F.lit(eos)).alias("tokens"))


def with_domain(docs: DataFrame, domains: DataFrame, label: str = "source") -> DataFrame:
    """docs with the id of their domain; a label without a domain is an error, as in a dictionary lookup."""
    named = docs.join(domains.select(F.col("name").alias("_name"), F.col("id").alias("_id")), F.col(label) == F.col("_name"), "left")
    known = F.when(F.col("_id").isNull(), F.raise_error(F.concat(F.lit("no such domain: "), F.coalesce(F.col(label), F.lit("null"))))).otherwise(F.col("_id"))
    return named.withColumn("domain_id", known).drop("_name", "_id")


def end_pieces(vocab: DataFrame, eos: int | None = None, braces: bool = True) -> DataFrame:
    """vocab (token_id, piece) with ends_sentence and newline. A piece ends a sentence if it has an end character and no
    bracket that it opens and does not close. braces=False leaves {} unchecked."""
    pairs = [p for p in BRACKETS if braces or p[0] != "{"]
    has_end = F.lit(False)
    for c in SENTENCE_ENDS:
        has_end = has_end | F.contains("piece", F.lit(c))
    closed = F.lit(True)
    for a, b in pairs:
        closed = closed & (~F.contains("piece", F.lit(a)) | F.contains("piece", F.lit(b)))
    ends = has_end & closed
    if eos is not None:
        ends = ends | (F.col("token_id") == eos)
    return vocab.withColumns({"ends_sentence": ends, "newline": ends & F.contains("piece", F.lit("\n"))})


def pack_fixed(encoded: DataFrame, length: int, by: str = "domain", order: str = "doc_id", flush_tail: bool = False) -> DataFrame:
    """by, chunk, n_tokens, tokens: each domain's token stream cut every `length` tokens, in order; the tail is dropped
    unless flush_tail. A document meets a chunk once, as a slice, so rows are documents and chunks, never tokens."""
    placed = prefix_sum(encoded.withColumn("_n", F.size("tokens").cast("long")), F.col("_n"), [order], "_start", [by])
    last = F.col("_start") + F.col("_n") - 1
    pieces = placed.filter("_n > 0").withColumn("chunk", F.explode(F.sequence(F.floor(F.col("_start") / length), F.floor(last / length))))
    from_ = F.greatest(F.col("_start"), F.col("chunk") * length)
    to = F.least(last + 1, (F.col("chunk") + 1) * length)
    pieces = pieces.select(by, "chunk", from_.alias("_from"), F.slice("tokens", (from_ - F.col("_start") + 1).cast("int"), (to - from_).cast("int")).alias("_part"))
    chunks = pieces.groupBy(by, "chunk").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_from", "_part"))), lambda x: x["_part"])).alias("tokens"))
    out = chunks.select(by, "chunk", F.size("tokens").cast("long").alias("n_tokens"), "tokens")
    return out if flush_tail else out.filter(F.col("n_tokens") == length)


def pack_stream(docs: list[tuple[list[int], list[bool]]], length: int, eos: int, ends: set[int], newlines: set[int] = frozenset(), bos: int | None = None, most: int = 2000, keep_singletons: bool = False, flush_tail: bool = False) -> Generator[tuple[list[int], int], None, int]:
    """Chunks of at most `length` tokens, cut after the last sentence end, from documents one after another, each with
    the padding it leaves. A document is (tokens, whether each one's text has a space).

    A sentence ends at eos, a newline token, or an end token if it or the next token has a space or nothing follows yet.
    What is cut off opens the next chunk. A chunk of one token is dropped unless keep_singletons. After `most` chunks in
    the course of one document the rest of the stream so far is discarded. The tail is kept only with flush_tail.
    Returns the number of tokens that no chunk has taken yet: as a first document they open the stream that follows.
    """
    room = length - (bos is not None)
    all_ = np.concatenate([np.asarray(t, np.int64) for t, _ in docs]) if docs else np.zeros(0, np.int64)
    space = np.concatenate([np.asarray(s, bool) for _, s in docs]) if docs else np.zeros(0, bool)
    strong = np.isin(all_, [eos, *newlines])
    weak = np.isin(all_, list(ends))
    spaced = space.copy()
    spaced[:-1] |= space[1:]
    index = np.arange(len(all_))
    last_end = np.maximum.accumulate(np.where(strong | weak & spaced, index, -1)) if len(all_) else index
    head = [] if bos is None else [bos]
    at = have = 0
    for tokens, _ in docs:
        have += len(tokens)
        n = 0
        while have - at >= room:
            end = at + room
            cut = int(last_end[end - 1])
            if end == have and weak[end - 1]:
                cut = end - 1
            stop = cut + 1 if cut >= at else end
            if bos is not None and cut < at and (bos == eos or bos in newlines):
                stop = at
            chunk = head + all_[at:stop].tolist()
            padding = length - len(chunk)
            at = stop
            if len(chunk) > 1 or keep_singletons:
                n += 1
                if n > most:
                    at = have
                    break
                yield chunk, padding
    if flush_tail and at < len(all_):
        yield head + all_[at:].tolist(), length - len(head) - (len(all_) - at)
    return len(all_) - at


def leftovers(docs: list[tuple[list[int], list[bool]]], ahead: tuple[list[int], list[bool]], length: int, eos: int, ends: set[int], newlines: set[int] = frozenset(), bos: int | None = None, most: int = 2000, keep_singletons: bool = False) -> np.ndarray:
    """For each number of tokens that may be carried into a stream, 0 to room - 1, how many pack_stream() leaves at its end.

    ahead has the tokens before the stream, as many as could be carried. Where a chunk ends depends on where it begins
    alone, so all beginnings advance together, and become few as soon as their chunks end at the same places."""
    room = length - (bos is not None)
    parts = [ahead, *docs]
    all_ = np.concatenate([np.asarray(t, np.int64) for t, _ in parts])
    space = np.concatenate([np.asarray(s, bool) for _, s in parts])
    strong, weak, spaced = np.isin(all_, [eos, *newlines]), np.isin(all_, list(ends)), space.copy()
    spaced[:-1] |= space[1:]
    index = np.arange(len(all_))
    last_end = np.maximum.accumulate(np.where(strong | weak & spaced, index, -1)) if len(all_) else index
    c, total = len(ahead[0]), len(all_)
    have = c + np.cumsum([len(t) for t, _ in docs])
    boundary = np.zeros(total + 1, bool)
    boundary[have] = True
    carried = np.arange(min(room - 1, c) + 1)
    at, doc, n, which = c - carried, np.full(len(carried), -1), np.zeros(len(carried), np.int64), carried.copy()
    turn = 0
    while (total - at >= room).any():
        go = total - at >= room
        end = np.minimum(at + room, total)
        of = np.searchsorted(have, end)
        cut = np.where(boundary[end] & weak[end - 1], end - 1, last_end[end - 1])
        stop = np.where(cut >= at, cut + 1, end)
        if bos is not None and (bos == eos or bos in newlines):
            stop = np.where(cut >= at, stop, at)
        counts = (stop - at + (bos is not None) > 1) | keep_singletons
        now = np.where(of == doc, n, 0) + counts
        stop = np.where(now > most, have[np.minimum(of, len(have) - 1)], stop)
        at, doc, n = np.where(go, stop, at), np.where(go, of, doc), np.where(go, now, n)
        turn += 1
        if turn % 8 == 0 and len(at) > 1:
            states, back = np.unique(np.stack([at, doc, n]), axis=1, return_inverse=True)
            (at, doc, n), which = states, back.ravel()[which]
    out = np.zeros(room, np.int32)
    out[carried] = (total - at)[which]
    return out


def blocks_of(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[list[tuple[int, np.ndarray, np.ndarray]]]:
    """Rows (_at, tokens, spaced) in blocks of whole documents, each closed by the one that brings it to `most` tokens."""
    block, size, before = [], 0, None
    for batch in batches:
        at, tokens, spaced = (batch.column(c) for c in ("_at", "tokens", "spaced"))
        edges = np.concatenate([[0], np.cumsum(pc.list_value_length(tokens).to_numpy(zero_copy_only=False))]).astype(np.int64)
        flat, flags = tokens.flatten().to_numpy(zero_copy_only=False), spaced.flatten().to_numpy(zero_copy_only=False)
        for k, a, b in zip(at.to_pylist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if before is not None and k < before:
                raise ValueError("documents are not in order")
            before = k
            block.append((k, flat[a:b], flags[a:b]))
            size += b - a
            if size >= most:
                yield block
                block, size = [], 0
    if block:
        yield block


def _last(docs: list[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The last n tokens of documents, or all there are, as one document."""
    some, left = [], n
    for t, s in reversed(docs):
        if left <= 0:
            break
        some.append((t[-left:], s[-left:]))
        left -= len(t)
    parts = list(zip(*some[::-1], strict=True)) or [(), ()]
    return tuple(np.concatenate([np.zeros(0, kind), *x]) for x, kind in zip(parts, (np.int32, bool), strict=True))


def pack_blocks(blocks: Iterable[list[tuple[np.ndarray, np.ndarray]]], length: int, *options, flush_tail: bool = False) -> Iterator[list[tuple[list[int], int]]]:
    """The chunks of pack_stream() over the documents of all blocks, a block's at a time: what a block leaves opens the next."""
    held = _last([], 0)
    for docs in blocks:
        docs, chunks = [held, *docs], []

        def fold(docs=docs):
            return (yield from pack_stream(docs, length, *options))

        run = fold()
        while True:
            try:
                chunks.append(next(run))
            except StopIteration as end:
                held = _last(docs, end.value)
                break
        yield chunks
    if flush_tail and len(held[0]):
        yield [(tail := [*([] if options[3] is None else [options[3]]), *held[0].tolist()], length - len(tail))]


def table_of_blocks(blocks: Iterable[list[tuple[np.ndarray, np.ndarray]]], head: tuple[np.ndarray, np.ndarray], length: int, *options) -> np.ndarray | None:
    """leftovers() over the documents of all blocks: the blocks' tables one after another. None without documents."""
    room, out = length - (options[3] is not None), None
    for docs in blocks:
        step = leftovers(docs, head, length, *options)
        out = step if out is None else step[out]
        head = _last([head, *docs], room - 1)
    return out


def pack_sentences(encoded: DataFrame, length: int, eos: int, ends: list[int], newlines: list[int] = (), bos: int | None = None, docs_per_stream: int = 10_000, most: int = 2000, flush_tail: bool = False, keep_singletons: bool = False) -> DataFrame:
    """domain, stream, seq, tokens, padding from encoded (doc_id, domain, tokens ARRAY<INT>, spaced ARRAY<BOOLEAN>).

    Packing is a fold over a domain's documents in order. To keep any domain, however large, from being one task's work,
    it is cut into streams of so many documents, and a stream opens with what the one before it left over. What a stream
    leaves is a function of how much it opens with, less than a chunk: a small table, found for all streams at once
    (leftovers). Tables are composed over blocks of streams and the blocks' over the domain, which gives every stream
    its opening; then all streams are folded at once. A task reads a stream in order, some AT_ONCE tokens at a time. So the number of passes is fixed, whatever the texts are like.
    """
    room, block = length - (bos is not None), 1000
    ranked = prefix_sum(encoded, F.lit(1).cast("long"), ["doc_id"], "_at", ["domain"])
    ranked = ranked.withColumn("stream", F.floor(F.col("_at") / docs_per_stream).cast("int")).select("domain", "stream", "_at", "tokens", "spaced")
    options = (length, eos, set(ends), frozenset(newlines), bos, most, keep_singletons)
    packed = "domain string, stream int, seq int, tokens array<int>, padding int"

    def fold(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, seq = next(batches), 0
        flush = flush_tail and bool(first.column("_last")[0].as_py())
        docs = ([x[1:] for x in block] for block in blocks_of(chain([first], batches), AT_ONCE))
        for chunks in pack_blocks(docs, *options, flush_tail=flush):
            n, at = len(chunks), np.cumsum([0, *(len(c) for c, _ in chunks)])
            tokens = np.fromiter(chain.from_iterable(c for c, _ in chunks), np.int32, int(at[-1]))
            columns = [pa.array([key[0].as_py()] * n, pa.string()), pa.array([key[1].as_py()] * n, pa.int32()), pa.array(range(seq, seq + n), pa.int32())]
            columns += [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(tokens)), pa.array([x for _, x in chunks], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["domain", "stream", "seq", "tokens", "padding"])
            seq += n

    in_order = lambda rows, *by: rows.repartition(*by).sortWithinPartitions(*by, "_at").groupBy(*by)

    if not ranked.filter("stream > 0").head(1):
        return in_order(ranked.withColumn("_last", F.lit(True)), "domain", "stream").applyInArrow(fold, packed)

    # a document without tokens adds nothing; the domain stands as text that is never null
    ranked = stored(ranked.filter(F.size("tokens") > 0).withColumn("_d", F.to_json(F.struct("domain"))))
    ends_of = lambda c: F.slice(c, F.greatest(F.size(c) - (room - 2), F.lit(1)), F.lit(max(1, room - 1)))
    backwards = Window.partitionBy("_d", "stream").orderBy(F.desc("_at"))
    late = ranked.withColumn("_n", F.row_number().over(backwards)).filter(F.col("_n") < max(2, room)).select("_d", "stream", F.struct("_at", ends_of("tokens").alias("t"), ends_of("spaced").alias("s")).alias("_x"))
    listed = late.groupBy("_d", "stream").agg(F.array_sort(F.collect_list("_x")).alias("_x"))
    joined = lambda xs, f: ends_of(F.flatten(F.transform(xs, lambda x: x[f])))
    tails = stored(listed.select("_d", "stream", joined("_x", "t").alias("t"), joined("_x", "s").alias("s")))
    lasts = tails.groupBy("_d").agg(F.max("stream").alias("_end"))
    # what lies ahead of a stream is the end of the one before it, or of several where one has too few tokens
    short = tails.join(lasts, "_d").filter((F.col("stream") < F.col("_end")) & (F.size("t") < room - 1)).head(1)
    before = Window.partitionBy("_d").orderBy("stream").rowsBetween(-(room if short else 1), -1)
    ahead = tails.select("_d", "stream", F.collect_list(F.struct("t", "s")).over(before).alias("_x")).select("_d", "stream", joined("_x", "t").alias("t"), joined("_x", "s").alias("s"))
    ahead = stored(ahead)

    def table(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = blocks_of(batches, AT_ONCE)
        first = next(blocks)
        head = first[0][1:] if first[0][0] < 0 else _last([], 0)
        docs = ([x[1:] for x in block if x[0] >= 0] for block in chain([first], blocks))
        out = table_of_blocks(filter(None, docs), head, *options)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([key[1].as_py()], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["_d", "stream", "table"])

    opened = ranked.select("_d", "stream", "_at", "tokens", "spaced").unionByName(ahead.select("_d", "stream", F.lit(-1).cast("long").alias("_at"), F.col("t").alias("tokens"), F.col("s").alias("spaced")))
    tables = stored(in_order(opened, "_d", "stream").applyInArrow(table, "_d string, stream int, table binary").withColumn("block", F.floor(F.col("stream") / block).cast("int")))

    def steps(rows: pd.DataFrame, by: str) -> list[tuple[int, np.ndarray]]:
        rows = rows.sort_values(by)
        return [(int(k), np.frombuffer(x, np.int32)) for k, x in zip(rows[by], rows["table"], strict=True)]

    def compose(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = np.arange(room, dtype=np.int32)
        for _, step in steps(rows, "stream"):
            out = step[out]
        return pd.DataFrame({"_d": [key[0]], "block": [key[1]], "table": [out.tobytes()]})

    def scan(by: str):
        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            now, out = int(rows["_from"].iloc[0]), []
            for k, step in steps(rows, by):
                out.append((key[0], k, now))
                now = int(step[now])
            return pd.DataFrame(out, columns=["_d", by, "_from"])

        return run

    blocks = tables.groupBy("_d", "block").applyInPandas(compose, "_d string, block int, table binary").withColumn("_from", F.lit(0))
    firsts = blocks.groupBy("_d").applyInPandas(scan("block"), "_d string, block int, _from int")
    froms = tables.join(firsts, ["_d", "block"]).groupBy("_d", "block").applyInPandas(scan("stream"), "_d string, stream int, _from int")
    opening = ahead.join(froms, ["_d", "stream"]).filter("_from > 0").select("_d", "stream", *(F.slice(c, F.size(c) - F.col("_from") + 1, F.col("_from")).alias(name) for c, name in (("t", "tokens"), ("s", "spaced"))))
    whole = ranked.drop("domain").unionByName(opening.withColumn("_at", F.lit(-1).cast("long"))).join(lasts, "_d")
    whole = whole.withColumn("_last", F.col("stream") == F.col("_end")).withColumn("domain", F.from_json("_d", "domain string")["domain"])
    return in_order(whole.select("domain", "stream", "_at", "tokens", "spaced", "_last"), "domain", "stream").applyInArrow(fold, packed)


def pack_stats(packed: DataFrame, encoded: DataFrame, length: int, by: str = "domain") -> DataFrame:
    """Per domain and in total (null domain): docs, chars, chunks, tokens, padding share of the packed table."""
    docs = encoded.rollup(by).agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))
    chunks = packed.rollup(by).agg(F.count("*").alias("chunks"), F.sum("n_tokens").alias("tokens"))
    both = docs.withColumnRenamed(by, "_by").join(chunks, F.col("_by").eqNullSafe(F.col(by)), "left").drop(by).withColumnRenamed("_by", by)
    filled = both.fillna(0, ["chunks", "tokens"])
    return filled.withColumn("padding", F.coalesce(F.try_divide(F.col("chunks") * length - F.col("tokens"), F.col("chunks") * length), F.lit(0.0)).cast("double"))


def file_order(files: DataFrame, name: str = "name", seed: int = 233) -> DataFrame:
    """files with their place in a seeded order; the list of files is metadata, small beside the data."""
    return files.withColumn("place", F.row_number().over(Window.orderBy(seeded(name, seed=seed), name)) - 1)


def doc_boundaries(rows: DataFrame, idx: str = "idx", size: str = "size") -> DataFrame:
    """rows with the number of documents that end before each: a row of size zero ends one."""
    return prefix_sum(rows, F.when(F.col(size) == 0, 1).otherwise(0).cast("long"), [idx], "doc")


def word_counts(docs: DataFrame, *keys: str) -> DataFrame:
    """keys, tok, n: the words of tokenize() in the texts of docs that have these keys, with their numbers. A task adds up
    what it counts, up to COUNTS_AT_ONCE bytes of it, so a pair may have several rows."""
    cut = docs.select(*keys, F.lower(F.coalesce("text", F.lit(""))).alias("_text"))
    schema = cut.select(*keys, F.lit("").alias("tok"), F.lit(0).cast("long").alias("n")).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _summed(chain.from_iterable(_counted(part, schema.names) for part in _parts(batches)), COUNTS_AT_ONCE)

    return cut.mapInArrow(count, schema)


def _summed(counts: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """counts, whose last column is a number, with it added up by the others: over all that is read until there are `most`
    bytes, and on if half of that is enough for the sums."""
    held, size = [], 0
    for batch in counts:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            held = _added(held)
            size = sum(b.nbytes for b in held)
            if 2 * size > most:
                yield from held
                held, size = [], 0
    yield from _added(held) if len(held) > 1 else held


def _added(batches: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    *keys, n = batches[0].schema.names
    return pa.Table.from_batches(batches).group_by(keys, use_threads=False).aggregate([(n, "sum")]).select([*keys, f"{n}_sum"]).rename_columns([*keys, n]).to_batches()


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches, whose last column is text, by some TEXT_AT_ONCE bytes of it."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.columns[-1]).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(ends):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TEXT_AT_ONCE, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def _cut(text: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """The words of tokenize() of lower-cased texts one after another, and how many each text has; found on bytes."""
    at = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at, kind = at - at[0], BYTES[data]
    starts = kind == 2
    starts[:1] |= kind[:1] == 1
    starts[1:] |= (kind[1:] == 1) & (kind[:-1] != 1)
    heads = at[:-1][at[:-1] < at[1:]]
    starts[heads] |= kind[heads] == 1  # no word goes on in the next text
    kept = kind != 0
    ends = np.append(np.cumsum(kept, dtype=np.int32)[starts] - 1, np.int32(np.count_nonzero(kept))).astype(np.int32)
    words = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(data[kept]))
    return words, np.diff(np.append(np.int32(0), np.cumsum(starts, dtype=np.int32))[at])


def _counted(part: pa.RecordBatch, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of word_counts() of one part: keys, then the lower-cased text."""
    *keys, text = part.columns
    found, n = _cut(text)
    if not len(found):
        return
    groups: dict[tuple, int] = {}
    group = np.array([groups.setdefault(k, len(groups)) for k in (zip(*(c.to_pylist() for c in keys), strict=True) if keys else [()] * len(text))], np.int64)
    coded = found.dictionary_encode()
    pairs, counts = np.unique(np.repeat(group, n) * len(coded.dictionary) + coded.indices.to_numpy(), return_counts=True)
    of, word = np.divmod(pairs, len(coded.dictionary))
    row = pa.array(np.unique(group, return_index=True)[1][of])
    yield pa.RecordBatch.from_arrays([*(c.take(row) for c in keys), coded.dictionary.take(pa.array(word)), pa.array(counts, pa.int64())], names=names)


def _commonest(counts: DataFrame, count: str, most: int) -> Column:
    """A condition that holds for the rows of the highest counts, as many as are not more than `most`: counts are told apart
    by eighths of their power of two, of which the driver gets one row each."""
    level = F.floor(F.log2(F.col(count).cast("double")) * 8)
    rows, least = 0, None
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), reverse=True):
        rows += r.n
        if rows > most:
            break
        least = r.level
    return F.lit(False) if least is None else level >= least


def _places(values: pa.Array, among: pa.Array) -> np.ndarray:
    """Where each value is in `among`, -1 where it is not."""
    return pc.fill_null(pc.index_in(values, value_set=among), -1).to_numpy().astype(np.int64)


def _priced(docs: DataFrame, costs: DataFrame) -> DataFrame:
    """doc_id, source, tok, n, large, small of docs that have a source. A row of docs with a word is one with the number of
    its words and the summed costs of those that costs (source, tok, large, small: sent to all tasks) has; source is null
    there and tok the id, so that such rows are dealt like others. Each other word of it is a row without costs."""
    names = ["doc_id", "source", "tok", "n", "large", "small"]
    sent = costs.select("source", "tok", "large", "small").toArrow().combine_chunks()
    sources, words = (pc.unique(sent.column(c)) for c in ("source", "tok"))
    pairs = _places(sent.column("source").combine_chunks(), sources) * len(words) + _places(sent.column("tok").combine_chunks(), words)
    order = np.argsort(pairs)
    # the last pair is above all others and costs nothing
    known = docs.sparkSession.sparkContext.broadcast((sources, words, np.append(pairs[order], np.iinfo(np.int64).max), *(np.append(sent.column(c).to_numpy()[order], 0.0) for c in ("large", "small"))))
    cut = docs.filter("source is not null").select("doc_id", "source", F.lower(F.coalesce("text", F.lit(""))).alias("_text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source string, tok string, n long, large double, small double"

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sources, words, pairs, *prices = known.value
        for part in _parts(batches):
            ids, of, text = part.columns
            found, n = _cut(text)
            coded = found.dictionary_encode()
            each, times = np.unique(np.repeat(np.arange(len(n)), n) * len(coded.dictionary) + coded.indices.to_numpy(), return_counts=True)
            row, code = np.divmod(each, max(1, len(coded.dictionary)))
            word, source = _places(coded.dictionary, words)[code], _places(of, sources)[row]
            pair = np.where((word < 0) | (source < 0), -1, source * len(words) + word)
            at = np.searchsorted(pairs, pair)
            rest = np.flatnonzero(pairs[at] != pair)
            at[rest] = len(pairs) - 1
            held = pa.array(np.flatnonzero(n))
            sums = (pa.array(np.bincount(row, weights=p[at] * times, minlength=len(n))).take(held) for p in prices)
            yield pa.RecordBatch.from_arrays([ids.take(held), pa.nulls(len(held), of.type), ids.take(held).cast(pa.string()), pa.array(n.astype(np.int64)).take(held), *sums], names=names)
            rows, which, times = pa.array(row[rest]), pa.array(code[rest]), times[rest]
            yield pa.RecordBatch.from_arrays([ids.take(rows), of.take(rows), coded.dictionary.take(which), pa.array(times, pa.int64()), *(pa.nulls(len(rows), pa.float64()) for _ in prices)], names=names)

    return cut.mapInArrow(price, schema)


def language_model_scores(docs: DataFrame, every: int = 20, training: DataFrame | None = None, common: int = 1 << 20) -> DataFrame:
    """idx, large, small: mean negative log-likelihood of each document under a unigram model of its own source, and
    under an add-one unigram model learned from all rows of training (text), or else from documents whose doc_id is
    divisible by `every`.

    Both models' counts are dealt once, by word. Words meet their costs in two ways. The commonest, at most `common`
    (source, word) pairs of at most 64 characters, are sent to all tasks, so that a document's share of them is added up
    where its text is cut; the other pairs, few of all occurrences, are shuffled. Which way a word takes does not change
    what it adds."""
    counted = word_counts(docs.withColumn("_held", F.col("doc_id") % every == 0), "source", "_held")
    learned = F.when(F.col("_held"), F.col("n")).otherwise(0) if training is None else F.lit(0)
    counted = counted.select("source", "tok", F.col("n").alias("c_own"), learned.cast("long").alias("c"))
    if training is not None:
        counted = counted.union(word_counts(training).select(F.lit(None).cast("string"), "tok", F.lit(0).cast("long"), "n"))
    by_word = Window.partitionBy("tok").orderBy("source")  # a row for each source that has the word
    both = counted.repartition("tok").groupBy("source", "tok").agg(F.sum("c_own").alias("c_own"), F.sum("c").alias("c"))
    whole = F.sum("c").over(by_word.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    pairs = stored(both.select("source", "tok", "c_own", whole.alias("c_ref"), (F.row_number().over(by_word) == 1).alias("first")))
    row = pairs.filter("first").agg(F.coalesce(F.sum("c_ref"), F.lit(0)), F.count_if(F.col("c_ref") > 0)).first()
    n_ref, v_ref = int(row[0]), int(row[1])
    own = pairs.filter("source is not null")
    total = stored(own.groupBy("source").agg(F.sum("c_own").alias("n_own")))  # written, so that its size is known: few rows are broadcast
    p_large = F.ln(F.col("c_own") / F.col("n_own"))
    p_small = F.ln((F.col("c_ref") + 1) / F.lit(float(n_ref + v_ref + 1)))
    costs = own.join(total, "source").select("source", "tok", "c_own", (-p_large).alias("large"), (-p_small).alias("small"))
    sent = _commonest(own, "c_own", common) & (F.length("tok") <= 64) & (F.length("source") <= 64)
    others = costs.filter(~sent).select("source", "tok", F.col("large").alias("_large"), F.col("small").alias("_small")).hint("shuffle_hash")  # a pair has one row: nothing is sorted
    met = _priced(docs, costs.filter(sent)).join(others, ["source", "tok"], "left")
    added = lambda c: F.sum(F.coalesce(c, F.col(f"_{c}") * F.col("n"))).alias(c)
    summed = met.groupBy("doc_id").agg(added("large"), added("small"), F.sum(F.when(F.col("source").isNull(), F.col("n"))).alias("n"))
    return summed.select(F.col("doc_id").alias("idx"), (F.col("large") / F.col("n")).alias("large"), (F.col("small") / F.col("n")).alias("small"))
