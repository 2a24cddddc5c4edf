"""Sainte-Laguë quotas, the mix and the pipeline."""

import re
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import mixing
from tests.llm.conftest import clashing


def plain_apportion(shares, seats, caps):
    got = [0] * len(shares)
    for _ in range(seats):
        live = [i for i, s in enumerate(shares) if s > 0 and got[i] < caps[i]]
        if not live:
            break
        i = min(live, key=lambda i: (-Fraction(shares[i]) / (2 * got[i] + 1), i))
        got[i] += 1
    return got


@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 40)), min_size=1, max_size=7), st.integers(0, 150))
@settings(max_examples=200, deadline=None)
def test_quotas_by_highest_quotients(sources, seats):
    shares, caps = [Fraction(s) for s, _ in sources], [c for _, c in sources]
    assert mixing.apportion(shares, seats, caps) == plain_apportion(shares, seats, caps)


@given(st.lists(st.integers(0, 1000), min_size=1, max_size=8))
@settings(max_examples=200, deadline=None)
def test_targets(sizes):
    weights = [1 + i % 3 for i in range(len(sizes))]
    out = mixing.targets(sizes, weights)
    assert sum(out) == sum(sizes) and all(0 <= t <= 3 * n for t, n in zip(out, sizes, strict=True))
    free = {t / w for t, n, w in zip(out, sizes, weights, strict=True) if n and t < 3 * n}
    assert len(free) <= 1 and all(t / w <= max(free) for t, n, w in zip(out, sizes, weights, strict=True) if free and t == 3 * n)


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("table", ["small", "odd"])
def test_mix(table, request):
    docs = clashing(request.getfixturevalue(table)).drop("size", "target", "part")
    out = mixing.mix(docs).collect()
    assert len(out) == docs.count()
    by = {}
    for r in out:
        assert r["size"] == n_words(r.text) and 0 <= r.taken <= 3 * r["size"]
        by.setdefault(r.source, []).append(r)
    names = sorted(by, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    sizes = [sum(r["size"] for r in by[s]) for s in names]
    for s, size, target in zip(names, sizes, mixing.targets(sizes, [1 + i % 3 for i in range(len(names))]), strict=True):
        assert {r.source_size for r in by[s]} == {size} and {r.target for r in by[s]} == {float(target)}
        assert abs(sum(r.taken for r in by[s]) - target) <= max(3, 0.01 * target)
    again = mixing.mix(docs.repartition(3)).collect()
    key = lambda r: (str(r.doc_id), str(r.text), r.taken)
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_emitted_words_are_those_taken(small):
    mixed = mixing.mix(small).cache()
    want = {r.source: r.t for r in mixed.groupBy("source").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "t").collect()}
    got = {}
    rows = mixing.emit(mixed)
    assert rows.columns == small.columns
    for r in rows.collect():
        got[r.source] = got.get(r.source, 0) + n_words(r.text)
        assert r.n_chars == len(r.text)
    assert got == {s: n for s, n in want.items() if n}


def test_empty(empty):
    assert mixing.mix(empty).count() == 0
    assert mixing.emit(mixing.mix(empty)).count() == 0


def test_each_shard_takes_its_quota(small):
    from collections import defaultdict

    rows = mixing.mix(small, shards=5)
    sizes, taken, edges = {}, {}, {}
    for r in rows.collect():
        sizes[r.source], edges[r.source], taken[r.doc_id] = r.source_size, r.edges, r.taken
    p = mixing.plan([sizes[s] for s in sorted(sizes)], [1 + i % 3 for i in range(len(sizes))], shards=5)
    by_shard, by_doc, spans = defaultdict(int), defaultdict(int), defaultdict(list)
    for r in mixing.stretches(rows).collect():
        by_shard[r.source, r.shard] += r.n_words
        by_doc[r.doc_id] += r.n_words
        spans[r.doc_id, r.copy].append((r.first, r.n_words))
    assert {d: n for d, n in taken.items() if n} == dict(by_doc)
    for s, quota in zip(sorted(sizes), p["quotas"], strict=True):
        for k, q in enumerate(quota):
            assert by_shard[s, k] == edges[s][k + 1] - edges[s][k]
            assert abs(by_shard[s, k] - q * p["block"]) <= p["block"] * (1 + q * p["block"] // max(1, sizes[s]))
    for parts in spans.values():  # stretches of a copy follow one another without gaps
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and parts[0][0] == 0
