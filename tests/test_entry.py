import importlib

import duckdb
import pytest

import __spark_entry__ as entry
from photoflow.plans import registry

DATA = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == pytest.approx(b, abs=1e-6)
    return a == b


def test_a_missing_part_is_left_out(monkeypatch):
    def absent(name):
        raise ImportError(name)

    with monkeypatch.context() as m, pytest.warns(UserWarning, match="photoflow.llm.registry"):
        m.setattr(importlib, "import_module", absent)
        assert set(entry.queries()) == set(registry.QUERIES)


def test_other_errors_are_not_hidden(monkeypatch):
    def broken(name):
        raise ValueError(name)

    monkeypatch.setattr(importlib, "import_module", broken)
    with pytest.raises(ValueError):
        entry.queries()


@pytest.mark.parametrize("name", registry.ORACLE_SQL)
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for table in ("lineitem", "supplier"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    relation = con.sql(registry.ORACLE_SQL[name])
    found = registry.QUERIES[name](spark, DATA)
    names = sorted(relation.columns)
    assert sorted(found.columns) == names
    mine = sorted(([r[c] for c in names] for r in found.collect()), key=str)
    theirs = sorted(([r[relation.columns.index(c)] for c in names] for r in relation.fetchall()), key=str)
    assert len(mine) == len(theirs)
    assert all(same(x, y) for a, b in zip(mine, theirs, strict=True) for x, y in zip(a, b, strict=True))
