"""Every registered query against its DuckDB oracle at sf0.01 (the driver's correctness gate),
and the entry contract."""

import importlib.util
import os

import pytest

from conftest import ROOT, SF001, SF01
from lendflow.plans.check import compare, duck_connection
from lendflow.plans.oracle import oracle_sql
from lendflow.plans.queries import queries

ROWS_ONLY = {"knn_lsh"}


def _entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    return m


def test_every_query_has_oracle_or_is_rows_only():
    missing = set(queries()) - set(oracle_sql())
    assert missing <= ROWS_ONLY, missing


@pytest.fixture(scope="module")
def con():
    return duck_connection(SF01)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, SF01, name, queries()[name], oracle_sql().get(name), con)
    assert r["status"] in ("ok", "rows-only"), r
    if r["status"] == "rows-only":
        assert r["spark_rows"] > 0


def test_entry_contract(spark):
    m = _entry()
    df = m.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["system_recommendation", "breach_key", "n_applications"]
    assert set(m.oracle_sql()) <= set(m.queries())
    assert SF001 in m.SMOKE_DIR
