"""Plans hold no operator that would not survive large tables."""

import re

import pytest

import __spark_entry__ as entry
from textmart.plans import catalogue

# One row per partition (id offsets) or a top-k may meet in one partition.
SINGLE_PARTITION_BY_DESIGN = {"word_topk", "ngram_topk"}
GLOBAL_AGGREGATE = {"profile_summary"}


def physical_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_plan(spark, sf_dir, name):
    plan = physical_plan(entry.queries()[name](spark, sf_dir))
    for operator in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in plan, operator
    if name not in SINGLE_PARTITION_BY_DESIGN | GLOBAL_AGGREGATE:
        # What is left are scalar subqueries and the id offsets: partial sums of one row per task.
        for found in re.finditer(r"Exchange SinglePartition.*\n(.*)", plan):
            below = found.group(1)
            assert "HashAggregate" in below and "partial" in below or "_part" in below, below


@pytest.mark.parametrize("name,columns", [
    ("word_count", {"doc_id", "text"}), ("clean_text_b", {"doc_id", "text"}), ("distinct_keys", {"o_orderpriority", "o_orderstatus"}),
    ("recode_case", {"o_orderkey", "o_orderstatus"}), ("classify_first", {"page_id", "url"}), ("fuzzy_match", {"p_brand", "p_name"}),
])
def test_scans_read_only_what_is_used(spark, sf_dir, name, columns):
    plan = physical_plan(entry.queries()[name](spark, sf_dir))
    for schema in re.findall(r"ReadSchema: struct<(.*?)>", plan):
        assert {c.split(":")[0] for c in schema.split(",")} <= columns


@pytest.mark.parametrize("name", ["recode_case", "group_normalize"])
def test_filters_reach_the_scan(spark, sf_dir, name):
    plan = physical_plan(entry.queries()[name](spark, sf_dir))
    assert re.search(r"PushedFilters: \[.*(EqualTo|In\(|Not\()", plan)


@pytest.mark.parametrize("name", ["classify_vote", "classify_vote_fallback", "classify_first", "name_key", "tokenize_regex"])
def test_row_expressions_need_no_shuffle(spark, sf_dir, name):
    plan = physical_plan(entry.queries()[name](spark, sf_dir))
    # Only a table in few splits is spread.
    assert all("REPARTITION_BY_NUM" in e for e in re.findall(r"Exchange .*", plan))


def test_counts_combine_before_the_shuffle(spark, sf_dir):
    plan = physical_plan(entry.queries()["word_count"](spark, sf_dir))
    assert "partial_count" in plan


def test_minhash_query_gives_all_pairs_that_agree_in_one_hash(spark, sf_dir):
    names = [f"h{i}" for i in range(1, 6)]
    signed = {r["doc_id"]: [r[n] for n in names] for r in entry.queries()["minhash_signatures"](spark, sf_dir).collect()}
    pairs = {(r["set_a"], r["set_b"]) for r in entry.queries()["neardup_exact"](spark, sf_dir).collect()}
    found = {(r["set_a"], r["set_b"]) for r in entry.queries()["neardup_minhash"](spark, sf_dir).collect()}
    assert found == {(a, b) for a, b in pairs if any(x == y for x, y in zip(signed[a], signed[b]))}
