"""Every registered query against its SQL twin on DuckDB."""

from __future__ import annotations

import pytest
from pyspark.sql.classic.dataframe import DataFrame

from changeflow.operators import listing
from checks.compare import difference, oracle_connection
from checks.oracles import ORACLES
from checks.queries import QUERIES

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
STREAMED = [n for n in QUERIES if n.startswith(("streamed_", "fan_out_"))]


@pytest.fixture(scope="module")
def oracle():
    return {folder: oracle_connection(folder) for folder in (SMALL, LARGER)}


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_small(spark, oracle, name):
    problem = difference(spark, oracle[SMALL], name, SMALL)
    assert problem in (None, "no rows")


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in STREAMED])
def test_larger(spark, oracle, name):
    assert difference(spark, oracle[LARGER], name, LARGER) is None


def test_pages_of_errors_beyond_what_the_driver_takes(spark, oracle, monkeypatch):
    monkeypatch.setattr(listing, "KEPT", 20, raising=False)
    monkeypatch.setattr(listing, "DRAWN", 20, raising=False)
    brought, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda df: brought.append(collect(df)) or brought[-1])
    pages = QUERIES["errors_pages_by_key"](spark, SMALL)
    assert max(map(len, brought)) <= 20 < pages.where("page = 1").count()
    monkeypatch.setattr(DataFrame, "collect", collect)
    assert difference(spark, oracle[SMALL], "errors_pages_by_key", SMALL) is None
