import itertools

import pytest
from pyspark.sql import functions as F

from textmart.functions import dates
from textmart.functions import fixed_values as fixed
from textmart.functions import text as tx

T = F.col("t")


def test_whitespace_real_and_spelt_out(value):
    assert value(tx.normalize_whitespace(T), "t string", "a\tb\nc\rd\\te\\nf\\rg\\x") == "a b c d e f g\\x"


def test_clean_presets(value):
    text = "Hello 2021 (x): a+b! كتاب، وقلم والكتاب ال يوم؟"
    wide = value(tx.clean_text(T, fixed.CLEAN_REPORT_WIDE, rules=()), "t string", text)
    assert set(wide) - set("كتاب وقلم والكتاب ال يوم") == {"+", "!"}
    report = value(tx.clean_text(T), "t string", text)
    assert report.startswith("Hello 2021  x   a+b! ")
    assert "والكتاب" not in report and " الكتاب يوم" in report
    ngram = value(tx.clean_text(T, fixed.CLEAN_NGRAM, tidy=True), "t string", text)
    assert ngram == "Hello x a+b! كتاب وقلم الكتاب يوم"


def test_clean_keeps_null(value):
    assert value(tx.clean_text(T, tidy=True), "t string", None) is None


def test_label_collapses_double_spaces_once(value):
    assert value(tx.normalize_label(T), "t string", " a    b-c ") == "a  b c"
    assert value(tx.normalize_label(T), "t string", "العدل والتنمية") == "العدل و التنمية"


@pytest.mark.parametrize("a,b", [
    ("محمد العلوي", "العلوي محمد"),
    ("أحمد  الحسني", "احمد الحسنى"),
    ("عبد الله مولاي", "عبدالله"),
    ("عبب د الحق بن علي", "بن علي عبب د الحق"),
])
def test_names_with_equal_keys(value, a, b):
    assert value(tx.comparison_key(T), "t string", a) == value(tx.comparison_key(T), "t string", b)


def test_key_rules_apply_in_order(value):
    # The article goes after "Abd al" has become one word.
    assert value(tx.comparison_key(T), "t string", "عبد الكريم المالكي") == "عبدكريم مكي"


def test_split_multi(value):
    cell = "a, b،c,,d "
    assert value(tx.split_multi(T), "t string", cell) == ["a", "b", "c", "", "d"]
    assert value(tx.split_multi(T, drop_empty=True), "t string", cell) == ["a", "b", "c", "d"]
    assert value(tx.split_multi(T, ",", trim=False), "t string", "a, b،c") == ["a", " b،c"]
    assert value(tx.split_multi(T), "t string", None) is None
    assert value(tx.split_multi(T), "t string", "") == [""]


def test_tokenize_regex(value):
    assert value(tx.tokenize_regex(T), "t string", 'Ab-c, "D"؛e:f_g..h') == ["ab", "c", "d", "e", "f", "g", "h"]
    assert value(tx.tokenize_regex(T), "t string", "") == []
    assert value(tx.tokenize_regex(T), "t string", None) is None


def test_tokenize_whitespace_keeps_inner_empty_words(spark):
    from pyspark.ml.feature import Tokenizer

    texts = ["A b", " a  b ", "", "a\t\nb \n ", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    ml = [r.w for r in Tokenizer(inputCol="t", outputCol="w").transform(df).collect()]
    ours = [r.w for r in df.select(tx.tokenize_whitespace(T).alias("w")).collect()]
    assert ours == ml


def test_tokenize_regex_is_the_ml_tokenizer(spark):
    from pyspark.ml.feature import RegexTokenizer

    texts = ["A-b, c", " x؛y  z..", "", "İstanbul É"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    ml = RegexTokenizer(inputCol="t", outputCol="w", pattern=fixed.TOKEN_GAPS).transform(df).collect()
    assert [r.v for r in df.select(tx.tokenize_regex(T).alias("v")).collect()] == [r.w for r in ml]


def test_has_words(spark):
    df = spark.createDataFrame([("",), (" \n",), (None,), ("a",)], "t string")
    assert [r.t for r in df.where(tx.has_words(T)).collect()] == ["", "a"]


def test_stop_words(value):
    words = F.split(T, " ")
    assert value(tx.remove_stop_words(words, ["The", "x"]), "t string", "the THE a x") == ["a"]
    assert value(tx.remove_stop_words(words, ["The"], ignore_case=False), "t string", "the The") == ["the"]
    assert value(tx.remove_stop_words(words, []), "t string", "the a") == ["the", "a"]
    many = [f"w{i}" for i in range(500)]
    assert value(tx.remove_stop_words(words, many), "t string", "w7 W499 w500") == ["w500"]
    assert value(tx.remove_stop_words(words, ["a"]), "t string", None) is None


@pytest.mark.parametrize("words,expected", [
    ([], None), (["a", "b"], None), (["a", "b", "c"], ["a", "a b", "a b c"]),
    (["a", "b", "c", "d"], ["a", "a b", "a b c", "b", "b c", "b c d"]),
])
def test_ngram_prefixes(value, words, expected):
    assert value(tx.ngram_prefixes(F.col("w"), 3), "w array<string>", words) == expected


def test_one_edit_keys_of_long_names(spark):
    import random

    rng = random.Random(4)
    words = set()
    for length in (38, 39, 40, 41, 42, 43, 90):
        for _ in range(12):
            word = "".join(rng.choices("abc", k=length))
            at = rng.randrange(length)
            words |= {word, word[:at] + word[at + 1:], word[:at] + "z" + word[at:], word[:at] + "z" + word[at + 1:]}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    keys = df.select("w", F.explode(tx.one_edit_variants(F.col("w"))).alias("k"))
    assert keys.groupBy("w").count().agg(F.max("count")).first()[0] <= 50
    met = keys.alias("x").join(keys.alias("y"), "k").select("x.w", F.col("y.w").alias("v")).distinct()
    met = {tuple(r) for r in met.where(F.levenshtein("w", "v", 1) >= 0).collect()}
    assert met == {tuple(r) for r in df.alias("x").crossJoin(df.alias("y")).select("x.w", F.col("y.w").alias("v"))
                   .where(F.levenshtein("w", "v", 1) >= 0).collect()}
    long = df.limit(1).select(F.explode(tx.one_edit_variants(F.repeat(F.lit("x"), 100_000))))
    assert long.count() == 4


def test_one_edit_variants_meet_exactly_at_distance_one(spark):
    alphabet = ["".join(p) for n in range(4) for p in itertools.product("ab", repeat=n)]
    words = spark.createDataFrame([(w,) for w in alphabet], "w string")
    v = words.select("w", F.explode(tx.one_edit_variants(F.col("w"))).alias("v"))
    met = v.alias("a").join(v.alias("b"), "v").where(F.levenshtein("a.w", "b.w") <= 1).select("a.w", "b.w").distinct().count()
    pairs = words.alias("a").join(words.alias("b"), F.levenshtein("a.w", "b.w") <= 1).count()
    assert met == pairs


@pytest.mark.parametrize("text,formats,expected", [
    ("2017-01-05", [], "2017-01-05"), ("2017-01-05 10:00:00", [], "2017-01-05"), ("05/01/2017", [], None),
    ("05/01/2017", ["dd/MM/yyyy"], "2017-01-05"), ("05/01/2017", ["MM/dd/yyyy"], "2017-05-01"),
    ("soon", ["dd/MM/yyyy"], None), (None, [], None),
])
def test_dates(value, text, formats, expected):
    assert value(dates.standardize_date(T, formats, on_error="null"), "t string", text) == expected


def test_reply_measures(value):
    schema = "a string, r string"
    assert value(dates.days_to_reply(F.col("r"), F.col("a")), schema, "2020-02-28", "2020-03-01") == 2
    assert value(dates.days_to_reply(F.col("r"), F.col("a")), schema, "2020-02-28", None) is None
    assert value(dates.is_replied(F.col("r")), schema, "2020-02-28", None) == 0
    assert value(dates.is_replied(F.col("r")), schema, None, "2020-02-28") == 1
