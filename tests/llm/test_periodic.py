"""Runs of repeated words against a plain search of every lag."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import periodic
from tests.llm.conftest import clashing


def plain_runs(w, least=12):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        same = [w[i] == w[i + q] for i in range(n - q)] + [False]
        begin = None
        for i, s in enumerate(same):
            if s and begin is None:
                begin = i
            elif not s and begin is not None:
                a, b = begin, i + q
                if b - a >= max(least, 2 * q) and not any(all(w[x] == w[x + d] for x in range(a, b - d)) for d in range(1, q)):
                    out.append((a, b - a, q))
                begin = None
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text, edit):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if edit and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for a, length, q in runs for i in range(a + q, a + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    text = " ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{a},{length},{q}\n" for a, length, q in runs)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), runs, text)


def sequences():
    part = st.builds(lambda w, times, rest: (w * times)[: len(w) * times - rest], st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 7), st.integers(0, 5))
    return st.lists(part, max_size=6).map(lambda parts: [x for p in parts for x in p])


@given(sequences(), st.sampled_from([None, 2, 6]))
@settings(max_examples=400, deadline=None)
def test_runs_and_counts(words, heavy):
    w = np.array(words, np.int64)
    counts = periodic.lag_counts(w, heavy)
    assert counts.tolist() == [0, *((w[:-q] == w[q:]).sum() for q in range(1, len(w) // 2 + 1))]
    assert periodic.runs_of(w, counts=counts) == plain_runs(words)


@pytest.mark.parametrize("period", [1, 2, 6, 35, 499])
def test_lags_that_a_run_explains_are_not_searched(period, monkeypatch):
    rng = np.random.default_rng(period)
    w = np.concatenate([rng.integers(1000, 10**6, 100), np.tile(np.arange(period), 3000 // period), rng.integers(1000, 10**6, 100)])
    searched = []
    islands = periodic._islands
    monkeypatch.setattr(periodic, "_islands", lambda words, q, least: searched.append(q) or islands(words, q, least))
    assert periodic.runs_of(w) == [(100, 3000 // period * period, period)] and searched == [period]


@pytest.mark.parametrize("edit", [False, True])
@pytest.mark.parametrize("table", ["small", "odd"])
def test_documents(table, edit, request):
    docs = request.getfixturevalue(table)
    if table == "odd":
        docs = docs.filter("n_chars < 100000 or n_chars is null")
    got = {(r.doc_id, r.collapsed_sha256, r.n_runs): tuple(r)[:8] + ([tuple(x) for x in r.runs], r.collapsed) for r in periodic.find(docs, edit=edit).collect()}
    want = [plain_row(r.doc_id, r.text, edit) for r in docs.collect()]
    assert {(r[0], r[7], r[1]): r for r in want} == got
    assert periodic.find(docs, edit=edit).count() == len(want)


def test_edits_reach_some_documents(small):
    plain, edited = ({r.doc_id: r.n_runs for r in periodic.find(small, edit=e).collect()} for e in (False, True))
    some = [d for d in plain if zlib.crc32(str(d).encode()) % 10 == 0]
    assert some and sum(edited[d] > plain[d] for d in some) > len(some) / 2 and all(edited[d] == plain[d] for d in plain if d not in some)


def test_very_long_empty_and_clashing(spark, odd, empty):
    assert periodic.find(empty).count() == 0
    assert periodic.find(clashing(odd).withColumnsRenamed({"h": "n_runs", "t": "runs"})).count() == odd.count()
    long = " ".join(f"w{i % 977}" for i in range(200_000))
    row = periodic.find(spark.createDataFrame([(1, long)], "doc_id long, text string"), texts=False).first()
    assert (row.n_runs, row.start, row.length, row.period, row.runs, row.collapsed) == (1, 0, 200_000, 977, None, None)
