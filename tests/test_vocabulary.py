"""Encoding by merge ranks against the library that the vocabularies are made for."""

import base64
import functools
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.operators import corpus, retokenize, vocabulary
from millrace.plans import catalog

ONE, OTHER = (public_tokenizers.path(n) for n in (catalog.ONE, catalog.OTHER))


@functools.cache
def library(path):
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=vocabulary.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("path", [ONE, OTHER])
def test_pieces_as_the_library(path):
    words = st.binary(max_size=12) | st.text("aeinorst ").map(str.encode) | st.integers(1, 40).map(lambda n: b"a" * n)

    @given(st.lists(words, max_size=8))
    @settings(max_examples=300, deadline=None)
    def run(pieces):
        at = np.cumsum([0, *map(len, pieces)])
        ids, edges = vocabulary.ranks(path).encode(np.frombuffer(b"".join(pieces), np.uint8), at)
        for i, p in enumerate(pieces):
            assert ids[edges[i] : edges[i + 1]].tolist() == (library(path)._encode_single_piece(p) if p else [])

    run()


ODD = [None, "", " ", "  a  b ", "don't we'll I'VE", "naïve Straße 東京 é́ \U0001f600", "x" * 700, "12 345\t6\n\n  end\x1c \x85\xa0 z", "<|endoftext|>", "a" * 50 + "b" * 50]


@pytest.mark.parametrize("path", [ONE, OTHER])
def test_texts_as_the_library(spark, sf_dir, path):
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    tokens = vocabulary.encode(rows, path)
    got = {r.doc_id: r.tokens for r in tokens.collect()}
    assert got == {i: library(path).encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert {r.doc_id: r.text for r in vocabulary.decode(tokens, path).collect()} == {i: t or "" for i, t in enumerate(texts)}
    ended = {r.doc_id: r.tokens for r in vocabulary.encode(rows, path, end=7).collect()}
    assert ended == {i: [*t, 7] for i, t in got.items()}
    assert vocabulary.encode(rows.limit(0), path).count() == 0


def test_parts_between_ends(spark):
    e = library(ONE).encode_ordinary
    rows = [(0, [*e("one two"), 50256, *e("three")]), (1, []), (2, [50256, 50256]), (3, None), (4, [*e("é"), 50256]), (5, e("last"))]
    frame = spark.createDataFrame(rows, "idx long, tokens array<int>").coalesce(1)
    got = {r.idx: r.text for r in vocabulary.decode(frame, ONE, end=50256).collect()}
    assert got == {0: ["one two", "three"], 1: [""], 2: ["", "", ""], 3: [""], 4: ["é", ""], 5: ["last"]}
    with pytest.raises(Exception, match="not in the vocabulary"):
        vocabulary.decode(frame, ONE).collect()


@pytest.mark.parametrize("length", [1, 2, 5, 1000])
@pytest.mark.parametrize("bos", [None, 9])
def test_retokenised_as_row_by_row(spark, length, bos):
    e = library(ONE).encode_ordinary
    texts = [["The quick brown fox", "don't"], [""], ["", ""], ["a"], ["naïve 東京 ", " two", "\n"], ["x y z " * 20]]
    rows = [(i, [t for k, p in enumerate(parts) for t in ([50256] if k else []) + e(p)]) for i, parts in enumerate(texts)]
    out = vocabulary.retokenize(spark.createDataFrame(rows, "idx long, tokens array<int>"), ONE, OTHER, 50256, 8, length, bos)
    plain = lambda t: retokenize.translate(t, library(ONE).decode, library(OTHER).encode_ordinary, 50256, 8, length, bos)
    assert {r.idx: r.tokens for r in out.collect()} == {i: plain(t) for i, t in rows}


def test_end_sets(spark):
    ends, newlines = vocabulary.end_sets(spark, ONE)
    pieces = [t.decode(errors="replace") for t in vocabulary.ranks(ONE).tokens]
    closed = lambda p: all(a not in p or b in p for a, b in ("[]", "()", "{}", "<>"))
    want = [i for i, p in enumerate(pieces) if any(c in p for c in ".!?;\n") and closed(p)]
    assert sorted([*ends, *newlines]) == want and newlines == [i for i in want if "\n" in pieces[i]] and 0 < len(newlines) < len(ends)


def test_chunks_as_one_fold(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ends, newlines = vocabulary.end_sets(spark, ONE)
    has = {i for i, t in enumerate(vocabulary.ranks(ONE).tokens) if b" " in t}
    by = defaultdict(list)
    for r in docs.orderBy("doc_id").collect():
        t = [*library(ONE).encode_ordinary(r.text or ""), catalog.END]
        by[r.source].append((t, [x in has for x in t]))
    want = {(d, i): (c, p) for d, rows in by.items() for i, (c, p) in enumerate(corpus.pack_stream(rows, 64, catalog.END, set(ends), frozenset(newlines)))}
    got = vocabulary.pack(docs.select("doc_id", docs.source.alias("domain"), "text"), ONE, 64, catalog.END)
    assert {(r.domain, r.seq): (r.tokens, r.padding) for r in got.collect()} == want
    assert catalog.QUERIES["pack_encoded_sentences"](spark, sf_dir).filter("n_tokens + padding <> 256").count() == 0


@pytest.mark.parametrize("sizes", [[], [0, 0], [3, 0, 4, 1, 9, 2, 2, 0, 30, 1], [5] * 50])
def test_batches_are_worked_on_in_parts(sizes):
    at, most = np.cumsum([0, *sizes]), 10
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes)), pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.arange(at[-1]), pa.int64()))], ["idx", "tokens"])
    parts = list(vocabulary.parts_of(iter([batch]), most))
    assert [x for p in parts for x in p.to_pylist()] == batch.to_pylist()
    assert all(sum(map(len, p.column(1).to_pylist()[:-1])) < most for p in parts if p.num_rows)
    # beyond one row's own elements no part has more than `most`
    assert len(parts) >= sum(sizes) // (most + max(sizes, default=0))
