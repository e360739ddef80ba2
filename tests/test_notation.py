import datetime

import pytest
from pyspark.sql import functions as F

from textmart.sources import manifest, notation


def cells(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "d string").coalesce(1)


def report(df):
    return {r["separator"]: r for r in notation.notations(df, ["d"]).collect()}


def dates(df, prefer=None, on_error="null"):
    learned = notation.learn(df, ["d"])["d"]
    return [r[0] and str(r[0]) for r in df.select(notation.read(F.col("d"), learned, prefer, on_error)).collect()]


CELLS = [
    ("2017-01-05", "2017-01-05"), ("2017/1/5", "2017-01-05"), ("20170105", "2017-01-05"), (" 2017.01.05 ", "2017-01-05"),
    ("2017-01-05 10:20:30", "2017-01-05"), ("2017/01/05T10:20:30Z", "2017-01-05"), ("5 January 2017", "2017-01-05"),
    ("5. Jan. 2017", "2017-01-05"), ("Jan 5, 2017", "2017-01-05"), ("05-JAN-17", "2017-01-05"), ("05-Jan-1999 3:05 PM", "1999-01-05"),
    ("25/12/70", "1970-12-25"), ("25/12/68", "2068-12-25"), ("12/25/2017", "2017-12-25"), ("7.7.2017", "2017-07-07"),
    ("29/02/2016", "2016-02-29"), ("29/02/2017", None), ("31.31.2017", None), ("2017-13-01", None), ("5 Foo 2017", None),
    ("25/12/2017 and so on", None), ("25/12/201", None), ("word", None), ("", None), ("  ", None), (None, None),
    ("1/2/" + "3" * 5000, None)]


def test_single_cells(spark):
    """All are readable one way only, so no cell needs another."""
    found = dates(cells(spark, *[text for text, _ in CELLS]))
    assert list(zip([text for text, _ in CELLS], found)) == CELLS


def test_a_cell_decides_for_its_separator_alone(spark):
    df = cells(spark, "05/03/2017", "25/03/2017", "05-03-2017", "05-25-2017", "05.03.2017", "04.04.2017", "2017-03-05", "5 March 2017")
    assert dates(df) == ["2017-03-05", "2017-03-25", "2017-05-03", "2017-05-25", None, "2017-04-04", "2017-03-05", "2017-03-05"]
    found = report(df)
    assert (found["/"]["first"], found["-"]["first"], found["."]["first"]) == ("day", "month", None)
    assert (found["/"]["open"], found["."]["open"], found["."]["same"], found["-"]["year_first"], found[" "]["named"]) == (0, 1, 1, 1, 1)
    assert notation.learn(df, ["d"])["d"] == notation.Notation({"/": "day", "-": "month"}, 1, 0)


def test_open_and_mixed_cells_are_not_guessed(spark):
    df = cells(spark, "05/03/2017", "25/03/2017", "03/25/2017", "x")
    assert dates(df) == [None, "2017-03-25", "2017-03-25", None]
    assert dates(df, prefer="day")[0] == "2017-03-05" and dates(df, prefer="month")[0] == "2017-05-03"
    learned = notation.learn(df, ["d"])["d"]
    assert learned == notation.Notation({}, 1, 1)
    with pytest.raises(Exception, match="not decided: 05/03/2017"):
        dates(df.where("d like '05%'"), on_error="raise")
    with pytest.raises(Exception, match="not a date: x"):
        df.where("d = 'x'").select(notation.read(F.col("d"), learned)).collect()
    assert df.where("d = 'x'").select(notation.read(F.lit(" "), learned)).first()[0] is None
    for wrong in ({"prefer": "year"}, {"on_error": "skip"}):
        with pytest.raises(ValueError):
            notation.read(F.col("d"), learned, **wrong)


def test_other_month_names_and_empty_tables(spark):
    months = {"janvier": 1, "févr": 2}
    df = cells(spark, "5 JANVIER 2017", "1 févr. 2017")
    learned = notation.learn(df, ["d"], months)["d"]
    found = df.select(notation.read(F.col("d"), learned, months=months)).collect()
    assert [r[0] for r in found] == [datetime.date(2017, 1, 5), datetime.date(2017, 2, 1)]
    assert notation.learn(df.limit(0), ["d"]) == {"d": notation.Notation()} and notation.learn(df, []) == {}


def test_ingest_finds_the_notation_by_group_and_column(spark):
    schema = "n int, d string, e string"
    one = spark.createDataFrame([(1, "05/03/2017", "05/03/2017"), (2, "25/03/2017", "03/25/2017"), (3, "-", None)], schema)
    two = spark.createDataFrame([(4, "05/03/2017", "2017-03-05")], schema)
    groups = [(manifest.SourceGroup("one", []), one)]
    found = manifest.ingest(groups, one.schema, dates={"d": None, "e": None}).orderBy("n").collect()
    assert [tuple(r) for r in found] == [(1, "2017-03-05", "2017-05-03"), (2, "2017-03-25", "2017-03-25"), (3, None, None)]
    groups = [(manifest.SourceGroup("two", []), two)]
    with pytest.raises(Exception, match="not decided"):
        manifest.ingest(groups, one.schema, dates={"d": None}).collect()
    assert manifest.ingest(groups, one.schema, dates={"d": None}, prefer="month").first()["d"] == "2017-05-03"
    assert manifest.ingest(groups, one.schema, dates={"d": None}, on_unfit="null").first()["d"] is None
