"""Every registered query against its SQL on the small tables."""

import pytest

import __spark_entry__ as entry
import check
from textmart.operators import joins
from textmart.plans import catalogue, oracle


@pytest.fixture(scope="module")
def con(sf_dir):
    return check.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, sf_dir, name):
    assert check.compare(spark, con, name, sf_dir).startswith("equal")


@pytest.mark.parametrize("name", ["fact_build", "dim_member", "party_resolve", "dup_flags", "dup_groups"])
def test_query_when_no_table_is_small_enough_to_broadcast(spark, con, sf_dir, name, monkeypatch):
    monkeypatch.setattr(joins, "fits", lambda *_: False)
    monkeypatch.setattr(joins, "HOT_KEYS", 50)
    assert check.compare(spark, con, name, sf_dir).startswith("equal")


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(oracle.SQL)


def test_entry(spark, sf_dir):
    df = entry.entry(spark)
    assert df.count() > 0 and "question_id" in df.columns
