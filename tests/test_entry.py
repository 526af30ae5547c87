"""The driver's contract, and registered queries against their SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from amberlode.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return v.isoformat() if hasattr(v, "isoformat") else "[" + ",".join(map(cell, v)) + "]" if isinstance(v, (list, tuple)) else repr(v)


def rows(columns, found):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(cell(r[i]) for i in order) for r in found)


def compared(spark, name, run, sql):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = run(spark, SF)
    got = con.execute(sql)
    assert rows(df.columns, df.collect()) == rows([c[0] for c in got.description], got.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, name):
    compared(spark, name, catalog.QUERIES[name], catalog.ORACLES[name])


def test_normalize_takes_connectors_as_its_sql(spark, tmp_path):
    texts = ["w e e e e e e e x", "du e du e du", "a e b ye c", "x ye e y", "la ou e e aion", "É-e Ü", "e", " - ", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = catalog.QUERIES["n1_normalize"](spark, str(tmp_path))
    got = con.execute(catalog.ORACLES["n1_normalize"])
    assert rows(df.columns, df.collect()) == rows([c[0] for c in got.description], got.fetchall())
