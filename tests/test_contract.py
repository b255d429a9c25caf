import importlib
import sys

import pytest

import __spark_entry__ as entry
from capturelake import catalogue


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_each_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("events", "documents", "embeddings", "pages", "labels", "part"):
        con.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    df = catalogue.queries()[name](spark, sf)
    rel = con.sql(catalogue.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    plain = lambda v: "~" if v is None else str(float(v)) if isinstance(v, (int, float)) else str(v)
    own = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    assert own == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


def test_archive_stands_alone(monkeypatch):
    """Without the training-data package the other queries are there."""
    monkeypatch.setattr(entry, "_found", lambda name: False)
    assert set(entry.queries()) == set(catalogue.queries())
    assert not [m for m in sys.modules if m.startswith("capturelake.llm")] or importlib.import_module("capturelake.catalogue")
