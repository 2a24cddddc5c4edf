"""Quality counts against a plain version; the order of the cascade changes no verdict."""

import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import quality
from tests.llm.conftest import clashing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    ws = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    times = {}
    for w in windows:
        times[w] = times.get(w, 0) + 1
    inside = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(3)}
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), len(ws) < 50 or 100 * len(inside) > 50 * len(ws)


@pytest.mark.parametrize("table", ["small", "odd"])
def test_against_plain_version(table, request):
    docs = request.getfixturevalue(table)
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = quality.base(docs).select("text", *columns).collect()
    assert len(got) == docs.count()
    for r in got:
        assert tuple(r)[1:] == plain(r.text)


def test_order_changes_no_verdict(small):
    rules = quality.rules()
    a = quality.cascade(small, rules).select("doc_id", F.col("rejected_by").isNull().alias("kept"))
    any_ = small.select("doc_id", ~F.exists(F.array(*(F.coalesce(r.rejects, F.lit(False)) for r in rules)), lambda x: x))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, any_.collect()))


def test_measured_order(spark, monkeypatch):
    """A rule whose rejections an earlier one has made already is asked last, whatever it rejects alone."""
    rows = spark.createDataFrame([(f"{i}", i) for i in range(100)], "text string, i int")
    rules = [quality.Rule("some", F.col("i") < 20), quality.Rule("most", F.col("i") < 50), quality.Rule("others", F.col("i") > 90), quality.Rule("none", F.col("i") < 0)]
    clock = iter(range(10**6))
    monkeypatch.setattr(quality.time, "perf_counter", lambda: float(next(clock)))  # every rule takes a second
    got = [(r.name, s, round(share, 4)) for r, s, share in quality.measure(rows, rules)]
    assert got == [("most", 1.0, 0.5), ("others", 1.0, 0.18), ("some", 1.0, 0.0), ("none", 1.0, 0.0)]
    got = [(r.name, round(share, 4)) for r, _, share in quality.measure(rows, rules, after=F.col("i").between(15, 100))]
    assert got == [("some", 1.0), ("most", 0.0), ("others", 0.0), ("none", 0.0)]
    assert [r.name for r, _, _ in quality.measure(rows.limit(0), rules)] == ["some", "most", "others", "none"]


@pytest.mark.parametrize("table", ["small", "odd"])
def test_rules_on_counts_are_the_rules(table, request):
    docs = quality.base(request.getfixturevalue(table))
    for a, b in zip(quality.rules(), quality.rules(counted=True), strict=True):
        assert docs.filter(F.coalesce(a.rejects, F.lit(False)) != F.coalesce(b.rejects, F.lit(False))).count() == 0, a.name


def test_kept_on_odd_rows(odd):
    rules = quality.rules()
    base = quality.base(odd)
    out = quality.cascade(base, quality.rules(counted=True), after=F.col("base_failed"), measured=quality.base(quality.sample(odd)))
    want = sorted((str(r.doc_id), str(r.text), r.gone) for r in base.select("doc_id", "text", F.exists(F.array(F.col("base_failed"), *(F.coalesce(x.rejects, F.lit(False)) for x in rules)), lambda x: x).alias("gone")).collect())
    assert sorted((str(r.doc_id), str(r.text), r.rejected_by is not None) for r in out.collect()) == want


def test_empty_and_clashing(empty, odd):
    assert quality.cascade(empty, quality.rules()).count() == 0
    docs = clashing(odd)
    out = quality.cascade(docs, quality.rules())
    assert out.columns == docs.columns and out.count() == odd.count() and out.schema["rejected_by"].dataType.simpleString() == "string"
