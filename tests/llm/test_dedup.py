"""Substring dedup and the n-gram join against plain versions."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from millrace.llm import components, ngram_join, suffix_dedup
from tests.llm.conftest import clashing

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_dedup(rows, length):
    """rows: (order key, text), in order."""
    seen, out = set(), []
    for key, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\x01" * length
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = len(re.findall(b"\x01+", bytes(gone)))
        out.append((key, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("parts", [1, 4])
def test_dedup_small(small, parts):
    docs = small.filter("length(text) < 20000")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(docs, parts=parts).collect())
    assert got == plain_dedup(rows, 100)


def test_dedup_of_shared_passages(spark):
    rng = random.Random(3)
    some = lambda n: "".join(rng.choice("abcdefgh \n") for _ in range(n))
    passages = [some(n) for n in (99, 100, 101, 350)] + ["é" * 60, "ab" * 200]
    rows = [(i, some(rng.randint(0, 150)) + rng.choice(passages) + some(rng.randint(0, 90)) + rng.choice(passages)) for i in range(150)]
    rows += [(150, rows[3][1]), (151, None), (152, ""), (153, "z" * 99), (154, "z" * 100), (155, "z" * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(clashing(docs), parts=3).collect())
    assert got == plain_dedup(rows, 100)


def test_dedup_odd_rows(odd, empty):
    out = suffix_dedup.dedup(odd).collect()
    assert len(out) == odd.count()
    twice = sorted(r.n_removed for r in out if r.doc_id == 5)
    assert twice[1] == [r.n_bytes for r in out if r.doc_id == 5][0]
    assert suffix_dedup.dedup(empty).count() == 0


def sets_of(text, k):
    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} or ({tuple(ws)} if ws else set())


def plain_join(rows, k, percent):
    sets = [(d, sets_of(t, k)) for d, t in rows]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    by = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            by[x].append(i)
    pairs = {(a, b) for ids in by.values() for a in ids for b in ids if a < b}
    for a, b in pairs:
        x, y = sets[a][1], sets[b][1]
        if 100 * len(x & y) >= percent * len(x | y):
            parent[root(a)] = root(b)
    least = defaultdict(lambda: None)
    for i, (d, _) in enumerate(sets):
        r = root(i)
        if d is not None:
            least[r] = d if least[r] is None else min(d, least[r])
    return [(d, len(s), least[root(i)] if s else d) for i, (d, s) in enumerate(sets)]


def key(row):
    return [(v is not None, v or 0) for v in row]


def compare(docs, k, percent, **options):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(docs, shingle=k, percent=percent, **options).collect()]
    assert sorted(got, key=key) == sorted(plain_join(rows, k, percent), key=key)


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_join_small(small, k, percent):
    compare(small, k, percent)


def edits(seed, groups=12, size=14):
    """Chains of copies, each a little further from the one before, around the threshold."""
    rng = random.Random(seed)
    rows, i = [], 0
    for _ in range(groups):
        ws = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([4, 9, 40, 150]))]
        for _ in range(size):
            rows.append((i, " ".join(ws)))
            i += 1
            ws = list(ws)
            for _ in range(rng.randint(0, max(1, len(ws) // 50))):
                ws[rng.randrange(len(ws))] = f"W{rng.randint(0, 400)}"
    return rows


@pytest.mark.parametrize(("block", "k", "percent"), [(1_500_000, 3, 90), (600, 3, 90), (600, 5, 80)])
def test_join_of_edited_copies(spark, block, k, percent):
    compare(spark.createDataFrame(edits(1), "doc_id long, text string"), k, percent, block=block)


def test_join_odd_rows(odd, empty):
    compare(odd, 3, 90)
    out = ngram_join.join(clashing(odd), 5, 80)
    assert out.count() == odd.count()
    assert ngram_join.join(empty).count() == 0


def test_search_finds_all_partners():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, rng.integers(5, 60)).astype(np.uint64)) for _ in range(200)]
    lists = ngram_join.Lists(sets)
    for i in range(0, 200, 7):
        for percent in (30, 60, 90):
            got = set(lists.search(lists.own[i], len(sets[i]), percent, np.zeros(200, bool)).tolist())
            want = {j for j in range(200) if 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))}
            assert got == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 180)] + [(1, 2), (2, 1), (3, 3), (5, 900), (900, 7)] + [(2000, i) for i in range(2001, 2200)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[i] == 100 for i in range(100, 181)) and got[2] == got[1] == 1 and got[7] == got[900] == 5 and all(got[i] == 2000 for i in range(2000, 2200)) and 3 not in got


def thue_morse(swap, n=1024):
    """Letters whose sums of powers modulo 2**64 are those of the other one, for any odd base."""
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(n))


def test_texts_of_equal_sums_are_not_linked(spark):
    rows = [(1, thue_morse(0)), (2, thue_morse(1)), (3, f"x {thue_morse(0)}"), (4, f"x {thue_morse(1)}"), (5, thue_morse(0))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    compare(docs, 3, 90)
    for length in (1024, 100):
        got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(docs, length=length).collect())
        assert got == plain_dedup(rows, length)


@pytest.mark.parametrize("k", [1, 5, 8, 9, 24, 32, 100])
def test_rolling_hash_is_one_of_the_bytes(k):
    data = np.random.default_rng(k).integers(0, 2, 4000).astype(np.uint8)
    h = suffix_dedup.rolling(data, k).tolist()
    strings = [data[i : i + k].tobytes() for i in range(len(data) - k + 1)]
    assert len(h) == len(strings) and len(set(h)) == len(set(strings)) == len(set(zip(h, strings, strict=True)))


def test_strings_of_one_first_hash_are_told_apart():
    """Pairs that share their first number are as good as others, in a batch and over batches."""
    rng = np.random.default_rng(2)
    family, before = suffix_dedup.Family(), set()
    for _ in range(30):
        pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 12, (40, 2))})
        keys, others = (np.array(x, np.uint64) for x in zip(*pairs, strict=True))
        assert family.seen(keys, others).tolist() == [p in before for p in pairs]
        before |= set(pairs)
    assert family.apart and sum(len(k) for k, _ in family.levels) == 12


def test_a_second_hash_is_another():
    data = np.random.default_rng(1).integers(0, 256, 5000).astype(np.uint8)
    for k in (5, 32, 100):
        assert (suffix_dedup.rolling(data, k) != suffix_dedup.rolling(data, k, 1000)).mean() > 0.99
