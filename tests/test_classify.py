import json
import random

import pytest
from pyspark.sql import functions as F

from textmart.functions import fixed_values as fixed
from textmart.operators import classify

S, Q, M = F.col("s"), F.col("q"), F.col("m")
SCHEMA = "s string, q string, m string"
SECTORS = {"water": ["dam", "river", "river", "x"], "road": ["road", "bridge", "x"], "edges": [" dam ", "law"]}
FIXED = {"law": ["justice", "justice and"], "water": ["justice and water"]}


def vote(value, subject, question, ministry, **options):
    label = classify.classify_vote([S, Q], SECTORS, gate=M, fallback=FIXED, **options)
    return value(label, SCHEMA, subject, question, ministry)


@pytest.mark.parametrize("row,expected", [
    (("a road", "and a bridge", "dams and roads"), "road"),
    (("dam", "road", "dam road"), "water"),                       # tie: the earlier label
    (("river", "road bridge", "dam road"), "water"),              # a keyword listed twice votes twice
    (("road", "road", "dam road"), "road"),                       # found in both texts: one vote
    (("dam", None, "law"), fixed.UNCLASSIFIED),                   # spaces in " dam " count
    (("the dam x", None, "the law"), "edges"),
    (("river", None, "roads"), fixed.UNCLASSIFIED),               # not a label of the ministry
    (("river", None, "justice and water"), "law"),                # fallback: two votes against one
    (("river", None, "justice"), "law"),
    ((None, None, None), fixed.UNCLASSIFIED),
])
def test_votes(value, row, expected):
    assert vote(value, *row) == expected


def test_dedupe_and_no_default(value):
    assert vote(value, "river", "road bridge", "dam road", dedupe=True) == "road"
    assert value(classify.classify_vote([S], SECTORS, default=None), SCHEMA, "none", None, None) is None


def test_votes_against_brute_force(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abc", k=rng.randint(1, 3))) for _ in range(60)]
    labels = {f"l{i}": rng.choices(words, k=8) for i in range(7)}
    backup = {f"f{i}": rng.choices(words, k=2) for i in range(3)}
    text = lambda n: "".join(rng.choices("abcd ", k=n))
    rows = [(text(12), text(30), rng.choice([text(5), None])) for _ in range(300)]

    def best(votes):
        return max(votes, key=votes.get) if votes and max(votes.values()) else None  # first of the largest

    def expected(s, q, m):
        m = m or ""
        gated = {lb: sum(k in s or k in q for k in ks) for lb, ks in labels.items() if any(k in m for k in ks)}
        return best(gated) or best({lb: sum(k in m for k in ks) for lb, ks in backup.items()}) or "none"

    df = spark.createDataFrame(rows, SCHEMA)
    got = df.select(classify.classify_vote([S, Q], labels, M, backup, "none").alias("v")).collect()
    assert [r.v for r in got] == [expected(*r) for r in rows]


ALIASES = {10: {"home": ["interior"], "head": ["head of state", "head"], "shadow": ["head of state council"]},
           11: {"home": ["head"], "other": ["interior affairs", "interior"]}}


@pytest.mark.parametrize("text,scope,match,expected", [
    ("ministry of interior", 10, "first", "home"),
    ("head of state council", 10, "first", "head"),
    ("head of state council", 10, "longest", "shadow"),
    ("interior affairs", 11, "exact", "other"),
    ("the interior", 11, "exact", None),
    ("nothing", 10, "first", None),
    ("interior", 12, "first", None),
    (None, 10, "first", None),
    ("head", None, "first", None),
])
def test_first_match(value, text, scope, match, expected):
    label = classify.classify_first(F.col("t"), F.col("n"), ALIASES, match)
    assert value(label, "t string, n long", text, scope) == expected


def test_dictionary_from_json(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps(SECTORS, indent=1), encoding="utf8")
    assert classify.load_dictionary(spark, f"{tmp_path}/d.json") == SECTORS


def test_dictionary_is_one_literal(spark):
    df = spark.range(1).select(classify.classify_vote([F.col("id").cast("string")], SECTORS).alias("v"))
    assert "from_json" not in df._jdf.queryExecution().optimizedPlan().toString()
