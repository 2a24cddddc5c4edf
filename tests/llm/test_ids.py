"""Token ids, packing and binary output against encoding each whole text by itself."""

import functools
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import encoding, packing, token_ids
from tests.llm.conftest import clashing

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def opened(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def whole(path, texts):
    t = opened(path)
    return [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]


def by_pieces(path, blanks, texts):
    ids, at = encoding.encoder(path, blanks).encode(pa.array(texts, pa.string()), 0)
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]


@pytest.mark.parametrize(("path", "blanks"), [(WORD, False), (BYTE, True)])
def test_pieces_give_the_ids_of_whole_texts(path, blanks):
    @settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(st.text(st.sampled_from("ab'sZÉé́ \t\n\r\x0b\x0c\x1c\x85\xa0  　﻿<|endoftext|>12.,#\U0001f600東"), max_size=30), max_size=5))
    def run(texts):
        assert by_pieces(path, blanks, texts) == whole(path, texts)

    run()


@pytest.mark.parametrize(("path", "blanks"), [(WORD, False), (BYTE, True)])
def test_real_texts(path, blanks, small):
    texts = [r.text for r in small.select("text").collect()]
    assert by_pieces(path, blanks, texts) == whole(path, texts)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("table", ["small", "odd"])
def test_packing(table, request):
    docs = request.getfixturevalue(table)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = []
    for (d, _), ids in zip(rows, whole(WORD, [t for _, t in rows]), strict=True):
        want += [(d is not None, d or 0, i // 2048, i, len(ids[i : i + 2048]), crc(ids[i : i + 2048])) for i in range(0, len(ids), 2048)]
    out = packing.pack(clashing(docs), WORD).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(x[4] for x in want)
    large = sum(x[4] > 1024 for x in want)
    assert len(bins) <= max(-(-total // 2048), large) * 1.03 + 1


@given(st.lists(st.integers(1, 100), max_size=200))
@settings(max_examples=100, deadline=None)
def test_plan_places_every_piece_once(lengths):
    hist = {k: lengths.count(k) for k in set(lengths)}
    runs = packing.plan(hist, 100, groups=8)
    placed = {}
    for n, ks in runs:
        assert n > 0 and sum(ks) <= 100
        for k in ks:
            placed[k] = placed.get(k, 0) + n
    assert placed == hist
    assert sum(n for n, _ in runs) <= 1.7 * -(-sum(lengths) // 100) + 2


def test_packing_empty(empty):
    assert packing.pack(empty, WORD).count() == 0


@given(st.lists(st.integers(0, 1 << 40), min_size=1, max_size=700))
@settings(max_examples=60, deadline=None)
def test_elias_fano_round_trip(values):
    values = np.sort(np.array(values))
    values = values if values[-1] < 1 << 20 else values >> 18
    ef = token_ids.EliasFano.from_bytes(token_ids.EliasFano.build(values).to_bytes())
    assert ef.values().tolist() == values.tolist()
    assert [ef.select(i) for i in range(len(values))] == values.tolist()
    for i, j in ((0, 0), (0, 1), (len(values) // 3, len(values)), (min(255, len(values)), min(513, len(values))), (len(values), len(values))):
        assert ef.between(i, j).tolist() == values[i:j].tolist()
    with pytest.raises(IndexError):
        ef.select(len(values))


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(1, 400, 100_000))
    assert len(token_ids.EliasFano.build(values).to_bytes()) * 8 / len(values) < 2 + np.log2(values[-1] / len(values)) + 0.5


@pytest.mark.parametrize("table", ["small", "odd"])
def test_written_ids_read_back(spark, table, request, tmp_path):
    docs = request.getfixturevalue(table)
    path = str(tmp_path / "ids")
    token_ids.write(clashing(docs), path, BYTE, ids_per_segment=3000)
    got = token_ids.read(spark, path).orderBy("start").collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    ids = whole(BYTE, [t for _, t in rows])
    key = lambda x: (x[0] is not None, x[0] or 0, *x[1:])
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=key) == sorted(((d, len(x), crc(x)) for (d, _), x in zip(rows, ids, strict=True)), key=key)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert order == sorted(order)
    segment = token_ids.Segment(spark.read.parquet(path).orderBy("part", "seg").first().segment)
    name, first = segment.doc(segment.n_docs - 1)
    assert (len(first), crc(first)) in [(r.n_tokens, r.ids_crc32) for r in got if r.doc_id == name]


def test_reading_by_blocks_of_documents(spark, odd, tmp_path):
    path = str(tmp_path / "ids")
    token_ids.write(odd, path, BYTE, parts=1)
    segment = token_ids.Segment(spark.read.parquet(path).first().segment)
    names, at = segment.docs(0, segment.n_docs)
    for size in (1, 2, 5):
        got = [segment.docs(i, min(i + size, segment.n_docs)) for i in range(0, segment.n_docs, size)]
        assert [n for block, _ in got for n in block] == names
        assert [x for _, block in got for x in block[:-1].tolist()] == at[:-1].tolist()


def test_no_documents_no_segments(spark, empty, tmp_path):
    token_ids.write(empty, str(tmp_path / "none"), BYTE)
    assert token_ids.read(spark, str(tmp_path / "none")).count() == 0


def thue_morse(swap):
    """1,024 letters whose sums of powers modulo 2**64 are those of the other one, for any odd base."""
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(1024))


@pytest.mark.parametrize(("path", "blanks"), [(WORD, False), (BYTE, True)])
def test_words_of_equal_sums_have_their_own_ids(path, blanks):
    texts = [thue_morse(0), f"x {thue_morse(1)} y", thue_morse(1), thue_morse(0)]
    assert by_pieces(path, blanks, texts) == whole(path, texts)


@pytest.mark.parametrize("blanks", [False, True])
def test_pieces_of_one_hash_have_their_own_ids(blanks, monkeypatch, small):
    """Ids go by bytes: a hash that is the same for words of one length changes nothing."""
    path = BYTE if blanks else WORD
    monkeypatch.setattr(encoding.K, "hash_runs", lambda data, starts, lengths, lower=True: lengths.astype(np.uint64))
    one = encoding.Encoder(path, blanks)
    texts = [r.text for r in small.select("text").collect()]
    for _ in range(2):
        ids, at = one.encode(pa.array(texts, pa.string()), 0)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == whole(path, texts)


def test_a_full_memory_starts_anew(monkeypatch, small):
    monkeypatch.setattr(encoding, "_MOST", 500)
    one = encoding.Encoder(WORD, False)
    texts = [r.text for r in small.select("text").collect()]
    for i in range(0, len(texts), 20):
        ids, at = one.encode(pa.array(texts[i : i + 20], pa.string()), 0)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == whole(WORD, texts[i : i + 20])
