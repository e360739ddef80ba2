import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from textmart.operators import star
from textmart.plans import mart

SECTORS = {"ماء": ["سد", "نهر", "ماء"], "طرق": ["طريق", "جسر"]}
FIXED_SECTORS = {"عدل": ["العدل"]}
MINISTRIES = {10: {"وزارة الماء": ["الماء"], "وزارة العدل": ["العدل"]},
              11: {"وزارة الماء والطرق": ["الماء", "الطريق"], "وزارة العدل": ["العدل"]}}

QUESTIONS = [
    # numero, depute, groupe, date_depot, ministere, sujet, question, date_reponse, periode
    ("1", "علي عمر، سارة زكي", "فريق-واحد", "2017-01-05", "الماء", "سد كبير", "بناء سد على نهر جديد", "2017-02-01", "A"),
    ("2", "علي عمر", "فريق واحد", "2017-01-04", "العدل", "محكمة", "موضوع آخر", "-", "A"),
    ("3", "هدى نور, علي عمر", "فريق اثنان", "2017-01-06", "الماء", "سد كبير", "بناء سد على نهر جديد", None, "B"),
    ("4", "مجهول", "فريق اثنان", "2017-01-07", "الثقافة", "س", "نص", None, "B"),
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("mart")
    columns = ["numero", "depute", "groupe", "date_depot", "ministere", "sujet", "question", "date_reponse", "periode"]
    frame = pd.DataFrame(QUESTIONS, columns=columns)
    frame.to_csv(root / "oral.csv", index=False)
    frame.assign(type="عادي", date_depot="2022-03-01", date_reponse="2022-03-11").iloc[:2].to_csv(root / "written.csv", index=False)
    (root / "manifest.json").write_text(json.dumps({
        "oral_10": {"type": "oral", "legislation": 10, "sources": ["oral.csv"]},
        "written_11": {"type": "written", "legislation": 11, "sources": ["written.csv"]}}))
    elected = spark.createDataFrame([
        ("2016-2021", "علي عمر", "P1", "فريق واحد"), ("2016-2021", "زكي سارة", "P1", "فريق واحد"),
        ("2016-2021", "نور هدي", "P2", "sans_groupe"), ("2016-2021", "س", "P2", "فريق اثنان"),
        ("2016-2021", "ص", "P3", "فريق اثنان"), ("2021-2026", "علي عمر", "P4", "فريق واحد"),
        ("2011-2016", "قديم", "P9", "فريق واحد"),
    ], "parlement string, prenomNomAR string, parti string, groupeAR string")
    inputs = mart.Inputs(f"{root}/manifest.json", str(root), elected, SECTORS, FIXED_SECTORS, MINISTRIES, ["على"])
    return mart.run(spark, inputs, f"{root}/out")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_lookups(tables):
    assert rows(tables["parties"], "parti") == [("P1",), ("P2",), ("P3",), ("P4",)]
    assert (10, "فريق واحد", "P1") in rows(tables["parties_groups"], "parlement", "groupeAR", "parti")


def test_member_parties(tables):
    got = {(r.depute, r.groupe, r.legislation_id): (r.party_code, r.method) for r in tables["deputies_parties"].collect()}
    # The group has a party per term, so it is not unique; the names decide.
    assert got["علي عمر", "فريق واحد", 10] == ("P1", "name")
    assert got["سارة زكي", "فريق واحد", 10] == ("P1", "name")
    assert got["هدى نور", "فريق اثنان", 10] == ("P2", "name")
    assert got["مجهول", "فريق اثنان", 10] == (None, None)
    assert got["علي عمر", "فريق واحد", 11] == ("P4", "name")


def test_labels(tables):
    got = {(r.question_type, r.numero): (r.sector, r.ministry_classified) for r in tables["classified_questions"].collect()}
    assert got["oral", 1] == ("ماء", "وزارة الماء")
    assert got["oral", 2] == ("عدل", "وزارة العدل")
    assert got["oral", 4] == ("غير مصنف", None)
    assert got["written", 1] == ("ماء", "وزارة الماء والطرق")


def test_dimensions(tables):
    assert rows(tables["session_dim"], "session_id", "session_label") == [(1, "A"), (2, "B")]
    assert rows(tables["deputy_team_dim"], "deputy_team_id") == [(1,), (2,)]
    assert rows(tables["deputy_party_dim"], "deputy_party_id", "deputy_party_code") == [(1, None), (2, "P1"), (3, "P2"), (4, "P4")]
    members = tables["deputy_dim"].collect()
    assert sorted(r.deputy_id for r in members) == list(range(1, len(members) + 1)) and len(members) == 7
    assert sum(r.deputy_party_id is None for r in members) == 3  # the null code has a row that equality never finds
    assert tables["ministry_dim"].where("ministry_name is null").count() == 1


def test_facts(tables):
    facts = {(r.question_type, r.question_number, r.deputy_id): r for r in tables["question_fact"].collect()}
    # Co-signers after either delimiter are kept; question 4 has no known ministry.
    per_question = tables["question_fact"].groupBy("question_type", "question_number").count().collect()
    assert {(r[0], r[1]): r[2] for r in per_question} == {
        ("oral", 1): 2, ("oral", 2): 1, ("oral", 3): 2, ("written", 1): 2, ("written", 2): 1}
    one = next(r for (kind, number, _), r in facts.items() if (kind, number) == ("oral", 1))
    assert (one.question_is_replied, one.question_days_to_reply, one.question_ask_date) == (1, 27, "2017-01-05")
    two = next(r for (kind, number, _), r in facts.items() if (kind, number) == ("oral", 2))
    assert (two.question_is_replied, two.question_days_to_reply, two.question_reply_date) == (0, None, None)
    assert two.question_id == 1 and one.question_id == 2
    assert tables["question_fact"].columns == [
        "question_id", "question_number", "legislation_id", "session_id", "question_nature", "question_type", "deputy_id",
        "deputy_team_id", "deputy_party_id", "ministry_id", "question_ask_date", "question_subject", "question_content",
        "question_sector", "question_is_replied", "question_reply_date", "question_days_to_reply"]


def test_facts_by_name_alone_fan_out(spark, tables):
    questions, codes = tables["classified_questions"], tables["deputies_parties"]
    dims = mart.build_dimensions(questions, codes)
    full = mart.build_facts(questions, dims)
    by_name = mart.build_facts(questions, dims, mart.NAME_ONLY_KEY)
    assert full.count() == 8 and by_name.count() > full.count()


def test_reports(tables):
    words = {r.word: r.n for r in tables["content_words"].collect()}
    assert words["سد"] == 6 and "على" not in words
    assert {r.ngram: r.n for r in tables["content_ngrams"].collect()}["بناء سد نهر"] == 6
    assert tables["content_tfidf"].count() == len(words)
    assert {r.word for r in tables["subject_words"].collect()} == {"سد", "كبير", "محكمة"}


def test_duplicates(tables):
    flagged = tables["question_fact_duplicates"]
    assert flagged.count() == tables["question_fact"].count()
    got = {(r.question_type, r.question_number): (r.is_duplicate, r.duplicate_question_count) for r in flagged.collect()}
    assert got["oral", 1] == got["oral", 3] == got["written", 1] == (1, 2)
    assert got["oral", 2] == (1, 1)
    sets = {(r.question_type, r.question_number): r.duplicate_set_id for r in flagged.collect()}
    assert sets["oral", 1] == sets["oral", 3] == sets["written", 1] != sets["oral", 2]


def test_duplicate_questions(tables):
    similar = tables["duplicate_questions_lhs"]
    assert similar.columns == [*tables["question_fact"].columns, "near_set_id", "near_questions", "JaccardDistance"]
    assert {r.JaccardDistance for r in similar.collect()} == {0.0}
    near = {(r.question_type, r.question_number): r.near_questions for r in similar.collect()}
    assert near == {("oral", 1): 3, ("oral", 3): 3, ("written", 1): 3, ("oral", 2): 2, ("written", 2): 2}


def test_null_dimension_members(spark):
    df = spark.createDataFrame([("a",), (None,), ("a",)], "k string")
    assert rows(star.build_dim(df, ["k"], "id"), "id", "k") == [(1, None), (2, "a")]
    dim = star.build_dim(df, ["k"], "id", null_keys=False)
    assert rows(dim, "id", "k") == [(1, "a")]
    full = star.build_dim(df, ["k"], "id")
    joined = star.star_join(df, [star.Dimension(full, {"k": "k"}, ["id"], null_safe=True)])
    assert joined.where(F.col("id").isNotNull()).count() == 3
    assert star.star_join(df, [star.Dimension(full, {"k": "k"}, ["id"])]).count() == 2
