"""The Katz model against a plain version with dictionaries, and its sums."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import katz
from tests.llm.conftest import clashing

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
END, BEGIN = "\x00end", "\x00begin"


def train():
    return F.crc32(F.col("doc_id").cast("string")) % 5 != 1


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), END]


class Plain:
    """Katz of order 3 with dictionaries: by[n] has the counts of n-grams by context."""

    def __init__(self, texts):
        self.uni, self.by = Counter(), {2: defaultdict(Counter), 3: defaultdict(Counter)}
        for t in texts:
            ws = [BEGIN, *tokens(t)]
            self.uni.update(ws[1:])
            for n in (2, 3):
                for i in range(n - 1, len(ws)):
                    self.by[n][tuple(ws[i - n + 1 : i])][ws[i]] += 1
        self.n = sum(self.uni.values())
        few = lambda counts: [sum(c == r for c in counts) for r in range(1, 7)]
        self.d = {1: katz.discounts(np.array(few(self.uni.values())))}
        for n in (2, 3):
            self.d[n] = katz.discounts(np.array(few([c for x in self.by[n].values() for c in x.values()])))
        left = sum((1 - self.d[1][c]) * c for c in self.uni.values() if c <= 5)
        self.total, self.unknown = (self.n, left / self.n) if left > 0 else (self.n + 1, 1 / (self.n + 1))
        self.alphas = {}

    def kept(self, n, r):
        return r * (self.d[n][r] if r <= 5 else 1)

    def p(self, context, w):
        if not context:
            return self.kept(1, self.uni[w]) / self.total if self.uni[w] else self.unknown
        n = len(context) + 1
        seen = self.by[n].get(context)
        if not seen:
            return self.p(context[1:], w)
        if context not in self.alphas:
            freed = sum(r - self.kept(n, r) for r in seen.values())
            base = sum(seen.values()) + (freed <= 0)
            self.alphas[context] = base, (freed if freed > 0 else 1) / base / (1 - sum(self.p(context[1:], x) for x in seen))
        base, alpha = self.alphas[context]
        return self.kept(n, seen[w]) / base if w in seen else alpha * self.p(context[1:], w)

    def row(self, text):
        ws = [BEGIN, *tokens(text)]
        base = sum(math.log10((self.uni[w] + 0.5) / (self.n + 0.5 * (len(self.uni) + 1))) for w in ws[1:])
        return len(ws) - 1, sum(self.uni[w] > 0 for w in ws[1:]), self.n, base, sum(math.log10(self.p(tuple(ws[max(0, i - 2) : i]), ws[i])) for i in range(1, len(ws)))


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


@pytest.mark.parametrize("table", ["small", "odd"])
def test_against_plain_version(table, request):
    docs = request.getfixturevalue(table)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = Plain([t for d, t in rows if not held(d)])
    want = sorted(((d is not None, d or 0), held(d), *model.row(t)) for d, t in rows)
    got = sorted(((r.doc_id is not None, r.doc_id or 0), *tuple(r)[1:]) for r in katz.score(clashing(docs), train()).collect())
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-6)


def test_probabilities_sum_to_one(small):
    model = Plain([r.text for r in small.limit(40).collect()])
    contexts = [(BEGIN,), *[(w,) for w, _ in model.uni.most_common(30)], *list(model.by[3])[:60], *sorted(model.by[3], key=lambda c: -sum(model.by[3][c].values()))[:20]]
    for u in contexts:
        assert sum(model.p(u, w) for w in [*model.uni, "\x00never"]) == pytest.approx(1, abs=1e-9)


def test_hot_contexts_give_the_same(spark):
    """Contexts of more than half of what a task holds are dealt by their n-grams."""
    docs = spark.createDataFrame([(i, " ".join(f"go x{(i * 7 + j) % 50}" for j in range(60))) for i in range(60)], "doc_id long, text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = Plain([t for d, t in rows if not held(d)])
    got = {r.doc_id: r.score for r in katz.score(docs, train(), held=100).collect()}
    assert got == {d: pytest.approx(model.row(t)[4], rel=1e-6) for d, t in rows}


@pytest.mark.parametrize("most", [40, 10_000])
def test_lots_of_several_slices_give_the_same(spark, most, small):
    """A lot's slices are answered together, hot contexts (most 40) are summed up in the lot."""
    docs = spark.createDataFrame([(i, " ".join(f"go {'stay ' * (j % 3)}x{(i * 7 + j) % (50 if i % 3 else 90)}" for j in range(40))) for i in range(60)], "doc_id long, text string")
    docs = docs.union(small.select("doc_id", F.substring("text", 1, 600)).filter("doc_id between 100 and 140")).coalesce(2)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = Plain([t for d, t in rows if not held(d)])
    got = {r.doc_id: r[2:] for r in katz.score(docs, train(), held=most, at_once=1500, share=4000).collect()}
    assert got == {d: pytest.approx(model.row(t), rel=1e-6) for d, t in rows}


def test_rows_exchanged_grow_with_the_table(spark, monkeypatch):
    """Four times the text makes four times the parts: a lot grows with them, or there would be 16 times the rows."""

    class Stop(Exception):
        pass

    def stop(dealt, parts):
        raise Stop(dealt.filter(F.col("kind") == katz.WORDS).count())

    def rows(n):
        docs = spark.range(n).select(F.col("id").alias("doc_id"), F.expr("repeat(concat('a', id % 91, ' b', id % 83, ' c', id % 79, ' d', id, ' '), 2000)").alias("text")).coalesce(1)
        with pytest.raises(Stop) as found:
            katz.score(docs, F.lit(True), held=4000)
        return found.value.args[0]

    monkeypatch.setattr(katz, "count_words", stop)
    assert rows(400) < 6 * rows(100)


def test_orders_of_numbers_that_do_not_fit():
    rng = np.random.default_rng(5)
    for most in (3, 1 << 20, katz.UNKNOWN):
        columns = [rng.choice(rng.integers(0, most, 50, endpoint=True), 4000) for _ in range(4)]
        order, new = katz.ranked(*columns)
        rows = list(zip(*(c.tolist() for c in columns), range(4000), strict=True))
        assert order.tolist() == [r[-1] for r in sorted(rows)]
        assert int(new.sum()) == len({r[:-1] for r in rows}) and new[0]


def test_empty_and_nothing_to_learn(empty, odd):
    assert katz.score(empty, train()).count() == 0
    out = katz.score(odd, F.lit(False)).collect()
    assert len(out) == odd.count() and all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in out)


def test_counts_and_numbers_have_64_bits():
    x = np.array([0, 5, (1 << 40) - 1, (1 << 52) + 3], np.int64)
    y, z, raw = katz.unpack(katz.pack(x, np.array([0.5, -1.25]), b"blob"))
    assert y.tolist() == x.tolist() and z.tolist() == [0.5, -1.25] and raw == b"blob"
    assert katz.Level(np.ones(6)).p(np.array([1 << 33]), 1 << 34)[0] == 0.5


def test_words_of_equal_sums_are_two(spark):
    one, other = ("".join("ab"[(bin(i).count("1") + s) % 2] for i in range(1024)) for s in (0, 1))
    docs = spark.createDataFrame([(i, f"{one} a b {one}" if i % 3 else f"{other} a") for i in range(1, 30)], "doc_id long, text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = Plain([t for d, t in rows if not held(d)])
    for r in katz.score(docs, train()).collect():
        assert tuple(r)[2:] == pytest.approx(model.row(dict(rows)[r.doc_id]), rel=1e-6)
