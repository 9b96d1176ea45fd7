"""Every query of the catalogue against its SQL in DuckDB, on the smallest sample tables."""

import os

import duckdb
import pytest

from leadmill.plans import catalogue, content_catalogue, entity_catalogue, page_catalogue, site_catalogue  # noqa: F401  (the others register in catalogue)


@pytest.fixture(scope="module")
def db(sf_dir):
    made = duckdb.connect()
    made.execute("set timezone='UTC'")
    for file in os.listdir(sf_dir):
        made.execute(f"create view {file.split('.')[0]} as select * from '{sf_dir}/{file}'")
    return made


def _rows(table):
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    columns = sorted(table.column_names)
    return columns, sorted("|".join(show(r[c]) for c in columns) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, db, sf_dir, name):
    assert _rows(catalogue.QUERIES[name](spark, sf_dir).toArrow()) == _rows(db.execute(catalogue.ORACLE_SQL[name]).to_arrow_table())


def test_every_oracle_has_its_query():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)


def test_scans_read_only_what_is_asked(spark, sf_dir):
    plan = catalogue.QUERIES["entity_latest_state"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "props" not in plan.split("ReadSchema")[-1]
