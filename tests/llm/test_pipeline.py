"""The stages of the corpus pipeline against what their operators' plain versions say, and the registered queries."""

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from millrace.llm import queries, toxicity
from tests.llm.conftest import clashing
from tests.llm.test_dedup import plain_join
from tests.llm.test_pii import plain


@pytest.fixture(scope="module")
def stages(spark, small, sf_dir):
    out, docs = [small], small
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, sf_dir))
        out.append(docs)
    return out


def test_columns_stay(stages, small):
    assert all(x.columns == small.columns for x in stages[:-1])


def test_toxic_rows_go(spark, stages, sf_dir):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[1].collect()}
    model = toxicity.learn(stages[0], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert kept == {r.doc_id for r in toxicity.score(stages[0], model).collect() if r.score < 0.3}
    clean = [d for d, t in truth.items() if t == 0]
    assert sum(d in kept for d in clean) >= 0.95 * len(clean)


def test_one_of_each_group_stays(stages):
    before = [(r.doc_id, r.text) for r in stages[1].collect()]
    want = sorted(d for (d, n, c) in plain_join(before, 5, 80) if n == 0 or d == c)
    assert sorted(r.doc_id for r in stages[2].collect()) == want


def test_personal_data_is_gone(stages):
    before = {r.doc_id: r.text for r in stages[2].collect()}
    after = {r.doc_id: r for r in stages[3].collect()}
    assert before.keys() == after.keys()
    for d, text in before.items():
        if not plain(text):
            continue
        for kind in {x.split(":")[0] for x in plain(text)}:
            assert f"<{kind}>" in after[d].text
        assert after[d].n_chars == len(after[d].text)


def test_mix_and_packing(stages):
    sequences = {}
    for r in stages[5].collect():
        sequences[r.sequence_id] = sequences.get(r.sequence_id, 0) + r.length
    assert sequences and max(sequences.values()) <= 2048
    assert {r.doc_id for r in stages[5].collect()} == {r.doc_id for r in stages[4].collect()}


def test_run_is_the_stages(spark, stages, sf_dir):
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, stages[5].collect()))


@pytest.mark.parametrize("table", ["odd", "empty"])
def test_stages_on_odd_rows(spark, table, request, sf_dir):
    docs = clashing(request.getfixturevalue(table))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, sf_dir))
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns


def test_registered():
    names = list(__spark_entry__.queries())
    assert [n.split("_")[0] for n in names if n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)] and "pipeline" in names
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


def test_sql_of_the_queries(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    for name, sql in queries.ORACLES.items():
        got = queries.QUERIES[name](spark, sf_dir)
        want = con.execute(sql)
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(got.columns)
        assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())


def test_unrelated_texts_stay_whatever_their_ids(spark, sf_dir):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    null = [(None, text(k)) for k in range(5)]
    both = [(7, text(10)), (7, text(11)), (8, text(12)), (9, text(13))]
    copies = [(None, text(12) + " end"), (None, text(4) + " end"), (3, text(13)), (9, text(13)), (7, text(11))]
    blank = [(None, ""), (None, ""), (7, None)]
    docs = spark.createDataFrame(null + both + copies + blank, "doc_id long, text string")
    got = sorted(map(tuple, corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()), key=str)
    of_four = [r for r in got if r[1] and r[1].startswith(text(4))]
    assert len(of_four) == 1 and of_four[0][0] is None
    assert [r for r in got if r not in of_four] == sorted(null[:4] + both[:3] + [(3, text(13))] + blank, key=str)
