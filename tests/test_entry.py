"""Every registered query of the board operators against its SQL."""

from __future__ import annotations

import math
import os

import pytest

SF = "/root/testdata/sf0.001"


def norm(rows, columns):
    def value(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "~"
        return str(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(value(r[c]) for c in columns) for r in rows)


def names():
    from boardlens.plans import catalogue

    return sorted(catalogue.queries())


@pytest.fixture(scope="module")
def db():
    import duckdb

    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return db


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, db, name):
    from boardlens.plans import catalogue

    sql = catalogue.oracle_sql()
    df = catalogue.queries()[name](spark, SF)
    got = [r.asDict() for r in df.collect()]
    assert got, "an empty result says nothing"
    if name in sql:
        rel = db.execute(sql[name])
        columns = [d[0] for d in rel.description]
        want = [dict(zip(columns, r, strict=True)) for r in rel.fetchall()]
        assert sorted(df.columns) == sorted(columns)
        assert norm(got, columns) == norm(want, columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    if os.path.isdir(SF):
        assert e.entry(spark).count() > 0
