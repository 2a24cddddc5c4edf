"""SpotSigs fingerprints against a plain version."""

import hashlib
import math

import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from millrace.llm import spotsigs
from tests.llm.conftest import clashing


def hashes(text, chain=2):
    words = regex.findall(r"[\p{L}\p{N}]+", text.lower())
    content, marked, after = [], [], False
    for w in words:
        if w in spotsigs.ANCHORS:
            after = True
        else:
            content.append(w)
            marked.append(after)
            after = False
    spots = [i for i, m in enumerate(marked) if m] or list(range(len(content)))
    out = set()
    for i in spots:
        h = 42
        for j in range(chain):
            h = xxhash.xxh64((content[i + j] if i + j < len(content) else "").encode(), seed=h).intdigest()
        out.add(h >> 32)
    return sorted(out, key=lambda x: x - (1 << 32) if x >> 31 else x)


def level(n):
    return math.floor(math.log(max(n, 1)) / math.log(2))


def alike(a, b):
    if not a and not b:
        return 1.0
    if not a or not b or abs(level(len(a)) - level(len(b))) > 4:
        return 0.0
    return len({*a} & {*b}) / len({*a} | {*b})


def plain(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0]))
    out = []
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        k = len(t) // 4
        e = t[: len(t) - k] + after[:k]
        a, b, c = hashes(t), hashes(e), hashes(after)
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), "".join(f"{x:08x}" for x in a), "".join(f"{x:08x}" for x in b), alike(a, b), alike(a, c)))
    return out


def test_against_plain_version(small):
    rows = [(r.doc_id, r.text) for r in small.collect()]
    got = sorted(map(tuple, spotsigs.compare_neighbours(small).collect()))
    for a, b in zip(got, sorted(plain(rows)), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:])


def test_odd_rows(odd, empty):
    docs = odd.dropDuplicates(["doc_id"])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    key = lambda r: (r[0] is not None, r[0] or 0)
    for a, b in zip(sorted(map(tuple, spotsigs.compare_neighbours(clashing(docs)).collect()), key=key), sorted(plain(rows), key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:])
    assert spotsigs.compare_neighbours(odd).count() == odd.count()
    assert spotsigs.compare_neighbours(empty).count() == 0


def test_near_copies_are_near(spark):
    words = [f"{'the ' if i % 3 == 0 else ''}term{i * 7 % 101}" for i in range(300)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:290] + ["other"] * 10)), (3, "nothing of the sort was in the plan of a stranger")], "doc_id long, text string")
    near = {r.doc_id: r.near_next for r in spotsigs.compare_neighbours(docs).collect()}
    assert near[1] > 0.9 and near[2] < 0.1


def rising(text, chain=2):
    one = lambda w, seed=42: xxhash.xxh64(w.encode(), seed=seed).intdigest()
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    words, content, marked = regex.findall(r"[\p{L}\p{N}]+", text.lower()), [], []
    for k, w in enumerate(words):
        if w not in spotsigs.ANCHORS:
            content.append(w)
            marked.append(k > 0 and words[k - 1] in spotsigs.ANCHORS)
    out = set()
    for i, w in enumerate(content):
        if marked[i] or i + 1 == len(content) or signed(one(w)) <= signed(one(content[i + 1])):
            h = 42
            for j in range(chain):
                h = one(content[i + j] if i + j < len(content) else "", h)
            out.add(h >> 32)
    return "".join(f"{x:08x}" for x in sorted(out, key=lambda x: x - (1 << 32) if x >> 31 else x))


def test_query_has_rising_chains(spark, small, odd, sf_dir):
    from millrace.llm import queries

    texts = {r.doc_id: r.text for r in small.collect()}
    got = queries.op1_spotsigs(spark, sf_dir).collect()
    assert len(got) == len(texts) and all(r.fingerprint == rising(texts[r.doc_id]) for r in got)
    docs = odd.dropDuplicates(["doc_id"])
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert all(r.fingerprint == rising(texts[r.doc_id]) for r in spotsigs.compare_neighbours(clashing(docs), rising=True).collect())


@pytest.mark.parametrize("anchors", [0, 1, 2])
def test_texts_with_few_anchors_are_near_their_edited_copies(spark, tmp_path, anchors):
    from millrace.llm import queries

    texts = [(n, " ".join(("the " if i < anchors else "") + f"item{n}x{i}" for i in range(n))) for n in (24, 40, 97, 300)]
    prose = [(n + 1, "the house of the north is on a hill and the river from it was in the valley " * 20) for n, _ in texts]
    spark.createDataFrame(texts + prose, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op1_spotsigs(spark, str(tmp_path)).collect()}
    for n, _ in texts:
        assert got[n].near_edited > 0.4 and len(got[n].fingerprint) >= 8 * n // 4
        assert got[n].near_next < 0.1


def test_likeness_of_sets_of_very_different_lengths(spark):
    df = spark.createDataFrame([(list(range(40)), [3]), (list(range(8)), list(range(4, 12)))], "a array<int>, b array<int>")
    got = df.select(spotsigs.likeness(F.col("a"), F.col("b")), spotsigs.likeness(F.col("a"), F.col("b"), floor=0.3)).collect()
    assert [tuple(r) for r in got] == [(1 / 40, 0.0), (4 / 12, 4 / 12)]


@pytest.mark.parametrize("floor", [0.3, 0.8])
def test_search_finds_what_comparing_all_does(spark, small, odd, empty, floor):
    some = small.select("doc_id", "text")
    prose = some.orderBy("doc_id").limit(30).collect()
    near = [(10_000 + i, r.text[: len(r.text) * (9 if i % 2 else 6) // 10]) for i, r in enumerate(prose)]
    docs = clashing(odd).select("doc_id", "text", "score", "n").unionByName(some, True).unionByName(spark.createDataFrame(near, "doc_id long, text string"), True)
    asked = docs.filter("doc_id % 50 = 0 or doc_id < 20 or doc_id is null or doc_id >= 10000")
    fps = spotsigs._classes(docs, True).select("doc_id", "fp").collect()
    classes = {}
    for r in fps:
        classes.setdefault(tuple(r.fp), []).append(r.doc_id)
    least = {fp: (min((d for d in ds if d is not None), default=None), len(ds)) for fp, ds in classes.items()}
    want = []
    for r in spotsigs._classes(asked, True).select("doc_id", "fp").collect():
        a = set(r.fp)
        for fp, (d, n) in least.items():
            b = set(fp)
            like = len(a & b) / len(a | b) if a | b else 1.0
            if like >= floor:
                want.append((r.doc_id, d, n, like))
    got = [tuple(r) for r in spotsigs.search(asked, docs, floor, rising=True).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(x[3] < 1 for x in want) > 5
    assert spotsigs.search(empty, docs, floor).count() == spotsigs.search(asked, empty, floor).count() == 0
