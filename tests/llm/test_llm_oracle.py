"""The operators' queries against their SQL on the small tables."""

import pytest

import __spark_entry__ as entry
import check
from textmart.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, sf_dir, name):
    assert check.compare(spark, check.connect(sf_dir), name, sf_dir).startswith("equal")


def test_all_are_registered():
    assert {*queries.QUERIES, "pipeline"} <= set(entry.queries()) and set(queries.SQL) <= set(entry.oracle_sql())
