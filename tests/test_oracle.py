"""Every registered query equals its SQL twin (DuckDB) on the driver tables."""

import pytest

import __spark_entry__ as ENTRY
from driver_tables import SF_SMALL
from emberspark.plans import oracle_check as OC

SQL = ENTRY.oracle_sql()
QUERIES = ENTRY.queries()


@pytest.fixture(scope="module")
def con():
    return OC.connect(SF_SMALL)


def test_every_query_is_registered_with_a_builder():
    assert set(SQL) <= set(QUERIES)
    assert len(QUERIES) >= 50


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, con, name):
    a, b = OC.run_both(spark, con, QUERIES[name], SQL[name], SF_SMALL)
    assert sorted(a[0]) == sorted(b[0]), (a[0], b[0])
    assert len(a[1]) == len(b[1])
    assert OC.same(a, b)
    if OC.in_order(SQL[name]):
        assert OC.same_order(a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only_queries_run(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert df.count() >= 1


def test_entry(spark):
    df = ENTRY.entry(spark)
    rows = df.collect()
    assert {r.risk_category for r in rows} <= {1, 2, 3, 4, 5}
    assert abs(sum(r.pct_valid for r in rows) - 100.0) < 1e-3


SPARK_TO_SQL = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                "date": "DATE", "boolean": "BOOLEAN"}


def _sql_type(spark_type: str) -> str:
    if spark_type.startswith("array<"):
        return _sql_type(spark_type[6:-1]) + "[]"
    return SPARK_TO_SQL.get(spark_type, spark_type)


@pytest.mark.parametrize("name", sorted(SQL))
def test_column_types_match_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    rel = con.sql(SQL[name])
    sql_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    for f in df.schema.fields:
        assert _sql_type(f.dataType.simpleString()) == sql_types[f.name], (name, f.name)
