import json

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmart.plans import mart
from textmart.sources import harmonize, manifest, tables


def test_sentinel_is_a_whole_cell(spark):
    df = spark.createDataFrame([("-", "x-y", 1.0), (None, "- ", float("nan"))], "a string, b string, c double")
    rows = harmonize.missing_to_null(harmonize.clean_cells(df)).collect()
    assert [tuple(r) for r in rows] == [(None, "x-y", 1.0), (None, "- ", None)]


def test_harmonize_renames_types_and_fills(spark):
    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("q", T.StringType()), T.StructField("z", T.StringType())])
    df = spark.createDataFrame([("1", "x", 0), ("one", "y", 0)], "n string, obs string, num_seance int")
    out = harmonize.harmonize(df, schema, {"q": ["question", "obs"]})
    assert out.dtypes == [("n", "bigint"), ("q", "string"), ("z", "string")]
    assert [tuple(r) for r in out.collect()] == [(1, "x", None), (None, "y", None)]


def test_whole_numbers_in_text(spark):
    schema = T.StructType([T.StructField("n", T.LongType())])
    cells = ["12", "12.0", " 7 ", "12.5", "x", None, "9007199254740993"]
    df = spark.createDataFrame([(c,) for c in cells], "n string")
    assert [r.n for r in harmonize.harmonize(df, schema).collect()] == [12, 12, 7, None, None, None, 9007199254740993]


@pytest.fixture()
def question_files(spark, tmp_path):
    oral = pd.DataFrame({
        "num_seance": ["1", "2", "3", "4"], "numero": ["10", "11", None, "12"], "periode": ["A", "A", "A", "-"],
        "depute": ["m1", "m2, m3", "m1", "m1"], "groupe": ["g-1", "g 1", "g", "g"],
        "date_depot": ["2017-01-05", "2017-01-06 00:00:00", "2017-01-07", "05/01/2017"],
        "ministere": ["M\\n1", "M", "M", "M"], "sujet": ["s\tt", "s", "s", "s"],
        "observation": ["line one\nline two", "-", "x", None], "date_reponse": ["2017-02-01", "-", None, None]})
    written = oral.drop(columns="num_seance").rename(columns={"observation": "question"}).assign(type=["n1", "-", "n2", "n3"])
    (tmp_path / "raw").mkdir()
    oral.to_csv(tmp_path / "raw/oral.csv", index=False)
    written.to_csv(tmp_path / "raw/written_a.csv", index=False)
    written.assign(numero=["20", "21", "22", "23"]).to_csv(tmp_path / "raw/written_b.csv", index=False)
    groups = {
        "oral_10": {"type": "oral", "legislation": 10, "sources": ["oral.csv"], "output": "unused"},
        "written_11": {"type": "written", "legislation": 11, "sources": ["written_a.csv", "written_b.csv"], "output": "unused"},
    }
    (tmp_path / "manifest.json").write_text(json.dumps(groups))
    return f"{tmp_path}/manifest.json", f"{tmp_path}/raw"


def test_ingest_questions(spark, question_files):
    rows = {(r.question_type, r.numero): r for r in mart.ingest_questions(spark, *question_files).collect()}
    assert sorted(rows) == [("oral", 10), ("oral", 11), ("written", 10), ("written", 11), ("written", 20), ("written", 21), ("written", 22)]
    first = rows["oral", 10]
    assert first.legislation_id == 10 and first.question_nature is None
    assert first.question == "line one line two" and first.sujet == "s t" and first.ministere == "M 1"
    assert (first.date_depot, first.date_reponse) == ("2017-01-05", "2017-02-01")
    # A sentinel question is kept as null: it was not missing when required cells were checked.
    assert rows["oral", 11].question is None and rows["oral", 11].date_reponse is None
    assert rows["written", 10].question_nature == "n1" and rows["written", 11].question_nature is None
    assert rows["written", 22].legislation_id == 11
    assert mart.ingest_questions(spark, *question_files).dtypes == [(f.name, f.dataType.simpleString()) for f in mart.QUESTIONS]


@pytest.mark.parametrize("kind", ["json", "orc", "parquet"])
def test_read_files_by_extension(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "a")], "n long, t string")
    path = f"{tmp_path}/x.{kind}"
    df.write.format(kind).save(path)
    assert [str(r.n) + r.t for r in manifest.read_files(spark, [path]).collect()] == ["1a"]


def test_workbooks_are_refused(spark):
    with pytest.raises(ValueError, match="CSV"):
        manifest.read_files(spark, ["a.csv", "b.XLSX"])


def test_a_group_may_mix_formats_and_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n,t\n1,x\n")
    (tmp_path / "b.csv").write_text("t,n\ny,2\n")
    (tmp_path / "c.csv").write_text("n,t\n3,z\n")
    (tmp_path / "d.json").write_text('{"n": 4, "u": "w"}')
    spark.createDataFrame([(5, "p")], "n long, t string").write.parquet(f"{tmp_path}/e.parquet")
    out = manifest.read_files(spark, [f"{tmp_path}/{f}" for f in ("a.csv", "b.csv", "c.csv", "d.json", "e.parquet")])
    assert sorted(map(str, (tuple(r) for r in out.select("n", "t", "u").collect()))) == sorted(map(str, [
        ("1", "x", None), ("2", "y", None), ("3", "z", None), ("4", None, "w"), ("5", "p", None)]))


def test_line_breaks_in_cells_are_never_torn_in_silence(spark, tmp_path):
    (tmp_path / "a.csv").write_text('n,t,u\n1,"x\ny",z\n')
    assert [tuple(r) for r in manifest.read_files(spark, [f"{tmp_path}/a.csv"], multi_line=True).collect()] == [("1", "x\ny", "z")]
    with pytest.raises(Exception, match="MALFORMED|[Mm]alformed"):
        manifest.read_files(spark, [f"{tmp_path}/a.csv"]).collect()


def test_unfit_cells_are_told(spark):
    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("d", T.StringType())])
    cells = [("12", "2017-01-05"), ("Q-12", "-"), ("12.5", None), ("-", None), (None, None)]
    df = spark.createDataFrame(cells, "n string, d string")
    group = manifest.SourceGroup("g", [])
    kept = manifest.ingest([(group, df)], schema, required=["n"], dates={"d": []}, on_unfit="null").collect()
    assert [(r.n, r.d) for r in kept] == [(12, "2017-01-05"), (None, None), (None, None), (None, None)]
    assert [tuple(r) for r in harmonize.rejects(df, schema).collect()] == [("n", "Q-12"), ("n", "12.5")]
    with pytest.raises(Exception, match="n is no bigint: (Q-12|12.5)"):
        manifest.ingest([(group, df)], schema, required=["n"]).collect()
    odd = spark.createDataFrame([("1", "05/01/2017")], "n string, d string")
    with pytest.raises(Exception, match="not a date"):
        manifest.ingest([(group, odd)], schema, dates={"d": []}).collect()
    assert manifest.ingest([(group, odd)], schema, dates={"d": ["dd/MM/yyyy"]}).first().d == "2017-01-05"


def test_union_fills_missing_columns(spark):
    a, b = spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2, "x")], "a int, b string")
    assert {tuple(r) for r in harmonize.union_all([a, b]).collect()} == {(1, None), (2, "x")}


def test_overwrite_of_the_own_source_keeps_rows(spark, tmp_path):
    path = f"{tmp_path}/t"
    tables.write_table(spark.range(5), path)
    tables.write_table(spark.read.parquet(path).withColumn("b", F.col("id") * 2), path)
    assert spark.read.parquet(path).agg(F.sum("b")).first()[0] == 20


@pytest.mark.parametrize("folder", ["plain", "with space", "ünï%20code"])
def test_overwrite_under_any_name_of_the_path(spark, tmp_path, folder):
    path = f"{tmp_path}/{folder}"
    tables.write_table(spark.range(5), path)
    tables.write_table(spark.read.parquet(f"file://{path}" if folder == "plain" else path).where("id > 0"), path)
    tables.write_table(spark.read.parquet(path).where("id > 1"), f"file:{path}" if folder == "plain" else path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [2, 3, 4]
    assert [p.name for p in tmp_path.iterdir()] == [folder]


def test_a_failed_write_leaves_the_table(spark, tmp_path):
    path = f"{tmp_path}/t"
    tables.write_table(spark.range(5), path)
    with pytest.raises(Exception, match="no luck"):
        tables.write_table(spark.read.parquet(path).select(F.raise_error(F.lit("no luck")).cast("long").alias("id")), path)
    assert spark.read.parquet(path).count() == 5


def test_scratch_folder_is_deleted(spark, tmp_path):
    with tables.scratch(spark, f"{tmp_path}/out") as folder:
        assert tables.materialize(spark.range(3), "x").count() == 3
        assert folder in tables.materialize(spark.range(3), "x").inputFiles()[0]
    assert not list(tmp_path.iterdir())


def test_materialize_uses_the_session_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    out = tables.materialize(spark.range(3), "x")
    assert out.count() == 3 and all(folder in f for f in out.inputFiles())
    assert tables.materialize(spark.range(0), "x").count() == 0


@pytest.mark.parametrize("master", ["local[2]", "spark://host:1"])
def test_without_a_shared_folder(master, tmp_path):
    from types import SimpleNamespace

    found = []
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: found[-1] if found else None, setCheckpointDir=found.append)
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=context)
    if master.startswith("local"):
        assert tables.shared_dir(session) == tables.shared_dir(session) == found[0] and len(found) == 1
    else:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            tables.shared_dir(session)


def test_spread_leaves_many_splits_alone(spark):
    df = spark.range(0, 100, 1, 64)
    assert tables.spread(df, "id") is df
    assert tables.spread(spark.range(0, 100, 1, 2), "id").rdd.getNumPartitions() == 16


def test_fits_counts_rows_and_bytes(spark):
    df = spark.range(10).select(F.repeat(F.lit("x"), 100).alias("t"))
    assert tables.fits(df, 10, 10_000) and not tables.fits(df, 9, 10_000) and not tables.fits(df, 10, 1000)
    assert tables.fits(df.where("false"), 0, 0)
