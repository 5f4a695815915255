"""The registered queries of small tables against their SQL."""

from pathlib import Path

import duckdb
import pytest

from ledgerloom.plans import exercise, queries


@pytest.fixture(scope="module")
def tables(sf_dir):
    c = duckdb.connect()
    for t in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM '{t}'")
    return c


@pytest.mark.parametrize("name", [*exercise.QUERIES, "one_field", "whole_model", "analyze_matrix", "coverage_matrix", "key_listing"])
def test_query_equals_sql(spark, sf_dir, tables, name):
    df = queries.QUERIES[name](spark, sf_dir)
    found = tables.execute(queries.SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=str) == sorted(found.fetchall(), key=str)


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.SQL)


def test_one_field_is_parsed_alone(spark, sf_dir):
    plan = queries.QUERIES["one_field"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    parse = plan[plan.index("from_xml") :].split("ignoreNamespace")[0]
    assert "StructField(ID," in parse and "InvoiceLine" not in parse and plan.count("from_xml") == 1
