import pytest

from textmart.operators.profile import profile


def test_profile(spark):
    df = spark.createDataFrame([(1, 2.0, "b"), (3, None, "a"), (5, 4.0, None), (7, 9.0, "c")], "i int, d double, s string")
    got = {r["column"]: r for r in profile(df).collect()}
    i = got["i"]
    assert (i["count"], i["mean"], i["min"], i["p25"], i["p50"], i["p75"], i["max"]) == (4, 4.0, 1.0, 1.0, 3.0, 5.0, 7.0)
    assert i["stddev"] == pytest.approx(2.5819888974716)
    assert (got["d"]["count"], got["d"]["mean"]) == (3, 5.0)
    assert (got["s"]["count"], got["s"]["mean"], got["s"]["min_text"], got["s"]["max_text"]) == (3, None, "a", "c")


def test_profile_agrees_with_summary(spark):
    df = spark.range(101).selectExpr("id * 3 as v")
    ours = profile(df).first()
    summary = {r["summary"]: float(r["v"]) for r in df.summary().collect()}
    assert [ours[c] for c in ("count", "mean", "stddev", "min", "p25", "p50", "p75", "max")] == pytest.approx(
        [summary[k] for k in ("count", "mean", "stddev", "min", "25%", "50%", "75%", "max")])
