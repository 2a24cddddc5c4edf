"""Every registered query of the reference's operators against its SQL on another engine."""

import math

import duckdb
import pytest

from millrace.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Queries that SQL cannot express, and the tests that hold them against a plain version.
PLAIN = {"pack_encoded_sentences": "test_vocabulary.py::test_chunks_as_one_fold"}


@pytest.fixture(scope="module")
def engine(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    if isinstance(value, (list, tuple)):
        return [plain(x) for x in value]
    return "null" if value is None else f"{float(value):.6g}" if isinstance(value, int) and not isinstance(value, bool) and abs(value) < 10**6 else str(value)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, engine, sf_dir, name):
    got = catalog.QUERIES[name](spark, sf_dir)
    if name in PLAIN:
        assert name not in catalog.ORACLES and got.count() > 0
        return
    want = engine.execute(catalog.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    a = sorted(([plain(v) for v in r] for r in got.select(*columns).collect()), key=str)
    assert a == sorted(([plain(v) for v in r] for r in want.fetchall()), key=str)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 100
    assert catalog.QUERIES.keys() <= __spark_entry__.queries().keys()
    assert catalog.ORACLES.keys() <= __spark_entry__.oracle_sql().keys()
