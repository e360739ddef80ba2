import pytest
from pyspark.sql import functions as F

from textmart.operators import joins
from textmart.operators.ids import assign_ids


def check_dense(df, key, n):
    rows = df.orderBy(*key).collect()
    assert [r.id for r in rows] == list(range(1, n + 1))


def test_ids_follow_the_order(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("v"))
    check_dense(assign_ids(df, ["k"]), ["k"], 1000)


def test_ids_with_a_hot_leading_key(spark):
    df = spark.range(0, 3000, 1, 8).select(F.when(F.col("id") < 2000, 0).otherwise(F.col("id")).alias("day"), "id")
    out = assign_ids(df.withColumnRenamed("id", "n"), ["day", "n"])
    check_dense(out, ["day", "n"], 3000)


def test_ids_of_few_rows_and_none(spark):
    check_dense(assign_ids(spark.createDataFrame([("b",), (None,), ("a",)], "k string"), ["k"]), [F.asc("k")], 3)
    assert assign_ids(spark.createDataFrame([], "k string"), ["k"]).count() == 0


def test_ids_are_the_same_with_other_partition_counts(spark):
    df = spark.range(500).select(F.xxhash64("id").alias("k"))
    first = {tuple(r) for r in assign_ids(df, ["k"]).collect()}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert {tuple(r) for r in assign_ids(df, ["k"]).collect()} == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture()
def skewed(spark):
    """A third of the rows has key 0, a tenth has none, the others have keys of their own."""
    i = F.col("id")
    key = F.when(i % 3 == 0, 0).when(i % 10 == 1, None).otherwise(i)
    rows = spark.range(3000).select(i.alias("row"), key.alias("k"))
    table = spark.range(0, 2500).select(i.alias("k"), (i * 2).alias("v")).unionByName(
        spark.createDataFrame([(None, -1)], "k long, v long"))
    return rows, table


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("null_safe", [True, False])
def test_lookup_is_a_plain_join_whatever_its_form(skewed, monkeypatch, how, null_safe):
    rows, table = skewed
    same = rows["k"].eqNullSafe(table["k"]) if null_safe else rows["k"] == table["k"]
    expected = sorted(tuple(r) for r in rows.join(table, same, how).select("row", rows["k"], "v").fillna(-9).collect())
    monkeypatch.setattr(joins, "HOT_KEYS", 20)
    for limit in (10_000, 100):  # broadcast, salted
        got = joins.lookup(rows, table, ["k"], how, null_safe, broadcast_rows=limit)
        assert sorted(tuple(r) for r in got.fillna(-9).collect()) == expected


def test_lookup_keeps_several_matches(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "r int, k string")
    table = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    for limit in (10, 1):
        got = joins.lookup(rows, table, ["k"], "left", broadcast_rows=limit).collect()
        assert sorted((r.r, r.v or 0) for r in got) == [(1, 1), (1, 2), (2, 0)]


def test_hot_part_is_bounded(spark):
    weighted = spark.range(1000).select("id", F.when(F.col("id") < 3, 1000).otherwise(1).alias("w"))
    hot = joins.hot_part(weighted, "w", keys=10)
    assert sorted(r.id for r in hot.collect()) == [0, 1, 2]


def test_join_weighted_is_a_plain_join(skewed, monkeypatch):
    rows, table = skewed
    rows = rows.where("k is not null")
    weights = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).join(table, "k")
    expected = sorted(tuple(r) for r in rows.join(weights, "k").select("row", "k", "n", "v").collect())
    for keys in (5, 10_000):
        monkeypatch.setattr(joins, "HOT_KEYS", keys)
        got = joins.join_weighted(rows, weights, "k", "n").select("row", "k", "n", "v")
        assert sorted(tuple(r) for r in got.collect()) == expected
