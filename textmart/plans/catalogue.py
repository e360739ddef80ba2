"""The registered queries: every operator applied to the given tables, whole tables and whole texts."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmart.functions import dates
from textmart.functions import fixed_values as fixed
from textmart.functions import text as tx
from textmart.operators import classify, frequency, ids, neardup, resolve, vocabulary
from textmart.operators.profile import profile
from textmart.plans import mart
from textmart.sources import manifest, notation, tables

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the queries over the given tables.
STOP_WORDS = ["the", "of", "And", "la", "le", "de", "der", "und", "el", "que", "pour"]
NAME_RULES = [*fixed.NAME_KEY_RULES, ("[éèêë]", "e"), ("[àâä]", "a"), ("[öô]", "o"), ("[.,]", "")]
TOPICS = {
    "alpha": ["tion", "the", "src1", "tion", "en"],
    "beta": ["ou", "eau", "src2", "src1", " le "],
    "gamma": ["sch", "ung", "src3", "src15", "der"],
    "delta": ["que", "ment", "src4", "src5", "fr"],
    "epsilon": ["Thr", "wh", "src6", "src17", "the"],
}
FIXED_TOPICS = {
    "zeta": ["src8", "src18"],
    "eta": ["src9", "src8", "src"],
    "alpha": ["src19", "9"],
}
HOSTS = {
    "en": {
        "commercial": ["example.com", "m.example"],
        "public": ["example.org", "example.net"],
        "mobile": ["//m.", "//m.thth"],
        "paged": ["?page=", "page=2&ref=x"],
    },
    "fr": {
        "mobile": ["//m."],
        "paged": ["?page="],
        "site": ["example.com", "example.net", "example.org", "http://"],
    },
    "de": {"secure": ["https://"], "open": ["http://", "example.com"]},
}
MINISTRIES = {
    10: {
        "Home": ["HOUSEHOLD", "FURNITURE"],
        "Industry": ["MACHINERY", "HOUSE"],
        "Transport": ["AUTO"],
    },
    11: {
        "Industry": ["MACHINERY", "AUTOMOBILE"],
        "Home": ["FURNITURE", "HOUSEHOLD"],
        "Construction": ["BUILDING", "BUILD"],
    },
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.read_table(spark, f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Texts are heavy per row, so a table in few splits is spread first."""
    return tables.spread(table(spark, sf_dir, "documents").select("doc_id", *columns), "doc_id")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for near duplicates, which shuffle much besides: not spread if every core has a split."""
    return tables.spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", per_core=1)


def _day(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


# --- questions derived from orders: one per order, its customer and a supplier as members ---

def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    shipped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("shipped"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    joined = (
        table(spark, sf_dir, "orders").drop("o_totalprice")
        .join(shipped, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(supplier, F.col("c_nationkey") == F.col("s_suppkey"), "left")
    )
    asked = F.col("o_orderdate")
    return joined.select(
        F.col("o_orderkey").alias("numero"),
        F.when(asked < F.lit("1998-01-01").cast("timestamp"), 10).otherwise(11).cast("long").alias("legislation_id"),
        F.date_format(asked, "yyyy-MM").alias("periode"),
        F.col("o_orderstatus").alias("question_type"),
        F.col("o_orderpriority").alias("question_nature"),
        F.when(F.col("o_orderpriority") == "2-HIGH", F.concat_ws(" ،", "c_name", "s_name")).otherwise(
            F.concat_ws(", ", "c_name", "s_name")).alias("depute"),
        F.replace("n_name", F.lit("_"), F.lit(" - ")).alias("groupe"),
        _day(asked).alias("date_depot"),
        F.concat(F.lit("Ministry of "), "c_mktsegment").alias("ministere"),
        F.col("o_orderpriority").alias("sujet"),
        F.col("c_mktsegment").alias("question"),
        F.when(F.col("shipped") >= asked, _day(F.col("shipped"))).alias("date_reponse"),
    )


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = _questions(spark, sf_dir)
    return tables.materialize(questions.withColumns({
        "ministry_classified": classify.classify_first(F.col("ministere"), F.col("legislation_id"), MINISTRIES),
        "sector": F.lower("question"),
    }), "classified")


def _parties(spark: SparkSession, sf_dir: str, questions: DataFrame) -> DataFrame:
    """A member's party is the region of its group; members of the first region have none."""
    nation = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    regions = nation.select(
        tx.normalize_label(F.replace("n_name", F.lit("_"), F.lit(" - "))).alias("groupe"),
        F.when(F.col("r_regionkey") > 0, F.col("r_name")).alias("party_code"))
    mentions = mart.member_mentions(questions).select("depute", "groupe", "legislation_id").distinct()
    return mentions.join(regions, "groupe")


def _dimensions(spark: SparkSession, sf_dir: str, questions: DataFrame | None = None) -> mart.Dimensions:
    if questions is None:
        questions = _classified(spark, sf_dir)
    return mart.build_dimensions(questions, _parties(spark, sf_dir, questions))


def dim_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dimensions(spark, sf_dir).member


def dim_team(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = mart.people(_classified(spark, sf_dir))
    return mart.star.build_dims({"deputy_team": members.select(F.col("deputy_team").alias("deputy_team_name"))})["deputy_team"]


def dim_party(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = _classified(spark, sf_dir)
    members = mart.labelled_people(questions, _parties(spark, sf_dir, questions))
    return mart.star.build_dims({"deputy_party": members.select("deputy_party_code")})["deputy_party"]


def dim_ministry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mart.star.build_dims(mart.question_values(_classified(spark, sf_dir)))["ministry"]


def dim_ministry_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dimension of its own, without a row for questions of no known ministry: not the one the facts use."""
    questions = _classified(spark, sf_dir)
    return mart.star.build_dim(questions.select(F.col("ministry_classified").alias("ministry_name")),
                               ["ministry_name"], "ministry_id", null_keys=False)


def dim_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("session_label"))
    return mart.star.build_dim(months, ["session_label"], "session_id")


def fact_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts, questions of no known ministry included, with the names their ids stand for."""
    questions = _classified(spark, sf_dir)
    dims = _dimensions(spark, sf_dir, questions)
    facts = mart.build_facts(questions, dims, order_by=["date_depot", "numero"], how="left")
    member = dims.member.select("deputy_id", "deputy_name", F.col("legislation_id").alias("member_term"))
    return (
        facts.join(member, "deputy_id", "left").join(dims.team, "deputy_team_id", "left")
        .join(dims.party, "deputy_party_id", "left").join(dims.ministry, "ministry_id", "left")
        .join(dims.session, "session_id", "left")
        .select("question_number", "deputy_name", "member_term", "deputy_team_name", "deputy_party_code", "ministry_name",
                "session_label"))


def fact_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = _classified(spark, sf_dir)
    return mart.build_facts(questions, _dimensions(spark, sf_dir, questions), order_by=["date_depot", "numero"])


def fact_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts joined by the member's name alone, counted: a member of several teams fans out."""
    questions = _classified(spark, sf_dir)
    facts = mart.build_facts(questions, _dimensions(spark, sf_dir, questions), mart.NAME_ONLY_KEY,
                             order_by=["date_depot", "numero"])
    return facts.groupBy("session_id", "ministry_id").agg(
        F.count(F.lit(1)).alias("facts"), F.count("deputy_party_id").alias("with_party"))


# --- ingest, cleaning, projections ---

UNION_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("nature", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("content", T.StringType()),
])
UNION_ALIASES = {"id": ["doc_id", "conv_id", "item_id"], "nature": ["lang", "role"], "content": ["observation", "text"]}


def ingest_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = [manifest.SourceGroup(name, [f"{sf_dir}/{name}.parquet"], {"kind": name})
              for name in ("documents", "conversations", "benchmark")]
    return manifest.ingest_files(spark, groups, UNION_SCHEMA, aliases=UNION_ALIASES, required=["content", "id"])


def ingest_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same texts, written as Parquet, JSON and CSV files with a manifest that lists them."""
    folder = f"{tables.shared_dir(spark)}/sources-{spark.sparkContext.applicationId}"
    for name, kind in (("documents", "parquet"), ("conversations", "json"), ("benchmark", "csv")):
        options = {"header": True, "quoteAll": True, "escape": '"', "ignoreLeadingWhiteSpace": False,
                   "ignoreTrailingWhiteSpace": False} if kind == "csv" else {}
        table(spark, sf_dir, name).write.mode("overwrite").format(kind).options(**options).save(f"{folder}/{name}.{kind}")
    listed = {
        "texts": {"type": "long", "sources": ["documents.parquet"]},
        "turns": {"type": "short", "sources": ["conversations.json"]},
        "items": {"type": "short", "sources": ["benchmark.csv"]},
    }
    spark.createDataFrame([(json.dumps(listed, indent=1),)], "value string").coalesce(1).write.mode("overwrite").text(
        f"{folder}/manifest")
    groups = manifest.load_manifest(spark, f"{folder}/manifest", folder, {"kind": "type"})
    return manifest.ingest_files(  # texts hold line breaks
        spark, groups, UNION_SCHEMA, lambda s, paths: manifest.read_files(s, paths, multi_line=True),
        aliases=UNION_ALIASES, required=["content", "id"])


def clean_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, "text").select("doc_id", tx.normalize_whitespace(F.col("text")).alias("cleaned"))


def _cleaned(drop: str, tidy: bool = False) -> Query:
    return lambda spark, sf_dir: documents(spark, sf_dir, "text").select(
        "doc_id", tx.clean_text(F.col("text"), drop, tidy=tidy).alias("cleaned"))


def date_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates that come as ISO text for some orders and in another notation for others."""
    written = F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(
        F.col("o_orderdate").cast("string"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", dates.standardize_date(written, ["dd/MM/yyyy"]).alias("order_day"))


def _written_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of orders, written in a way that depends on the priority; nobody says how."""
    ways = {"1": "yyyy-MM-dd HH:mm:ss", "2": "dd/MM/yyyy", "3": "M-d-yyyy", "4": "d MMMM yyyy"}
    priority, written = F.substring("o_orderpriority", 1, 1), F.date_format("o_orderdate", "d.M.yyyy")
    for key, way in ways.items():
        written = F.when(priority == key, F.date_format("o_orderdate", way)).otherwise(written)
    return table(spark, sf_dir, "orders").select("o_orderkey", written.alias("written"))


def date_notation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in five notations, found from the column itself."""
    rows = _written_days(spark, sf_dir)
    found = notation.learn(rows, ["written"])["written"]
    return rows.select("o_orderkey", _day(notation.read(F.col("written"), found)).alias("order_day"))


def date_notation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notation.notations(_written_days(spark, sf_dir), ["written"]).withColumnRenamed("first", "comes_first").drop("column")


def recode_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").where((status == "F") | (status == "O")).select(
        "o_orderkey", F.when(status == "F", 10).otherwise(11).alias("term"))


def group_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat(F.lit(" "), "p_brand", F.lit(" - "), "p_type", F.lit("-  وال"), "p_name", F.lit("-"))
    return table(spark, sf_dir, "part").where(F.col("p_type") != "PROMO").select(
        "p_partkey", tx.normalize_label(label).alias("label"))


def distinct_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus").distinct()


def member_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that the correction rules touch, in between others."""
    inner, whole = (pattern.strip("^$") for pattern, _ in fixed.MEMBER_RULES)
    third = F.col("c_nationkey") % 3
    name = F.when(third == 0, F.concat_ws(" ", "c_name", F.lit(inner))).when(third == 1, whole).otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", tx.apply_rules(name, fixed.MEMBER_RULES).alias("member"))


def explode_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = documents(spark, sf_dir, "text").select("doc_id", F.explode(tx.split_multi(F.col("text"))).alias("part"))
    return parts.groupBy("doc_id", "part").agg(F.count(F.lit(1)).alias("n"))


def name_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", tx.comparison_key(F.col("text"), NAME_RULES).alias("name_key"))


def tokenize_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tx.tokenize_regex(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("words")).select(
        "conv_id", "turn", F.size("words").cast("long").alias("n_tokens"), F.array_join("words", " ").alias("tokens"))


def tokenize_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tx.tokenize_whitespace(F.col("text"))
    return table(spark, sf_dir, "conversations").where(tx.has_words(F.col("text"))).select(
        "conv_id", "turn", words.alias("words")).select(
        "conv_id", "turn", F.size("words").cast("long").alias("n_tokens"), F.array_join("words", "|").alias("tokens"))


def profile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag"]
    found = profile(table(spark, sf_dir, "lineitem"), columns)
    rounded = [F.round(c, 3).alias(c) for c in ("mean", "stddev", "min", "p25", "p50", "p75", "max")]
    return found.select("column", "count", *rounded)


def roundtrip_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written to a table, then rewritten in place from that table itself."""
    path = f"{tables.shared_dir(spark)}/roundtrip-{spark.sparkContext.applicationId}"
    tables.write_table(table(spark, sf_dir, "orders"), path)
    tables.write_table(tables.read_table(spark, path), path)
    return tables.read_table(spark, path).select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


def surrogate_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return ids.assign_ids(orders, ["o_orderdate", "o_orderkey"], "order_id").select("order_id", "o_orderkey")


def reply_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    replied = F.when(F.col("l_shipdate") >= F.col("o_orderdate"), F.col("l_shipdate"))
    return joined.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", dates.is_replied(replied).alias("is_replied"),
        dates.days_to_reply(replied, F.col("o_orderdate")).alias("days_to_reply"))


# --- labels ---

def classify_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, "text", "lang").select(
        "doc_id", classify.classify_vote([F.col("lang"), F.col("text")], TOPICS, default="none").alias("label"))


def classify_vote_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, "text", "lang", "source").select("doc_id", classify.classify_vote(
        [F.col("lang"), F.col("text")], TOPICS, gate=F.col("source"), fallback=FIXED_TOPICS, default="none").alias("label"))


def classify_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    scope = F.regexp_extract(url, "/(en|fr|de|es)/", 1)
    start = F.regexp_extract(url, "^(https?://)", 1)
    return table(spark, sf_dir, "pages").select(
        "page_id",
        classify.classify_first(url, scope, HOSTS).alias("first_label"),
        classify.classify_first(url, scope, HOSTS, "longest").alias("longest_label"),
        classify.classify_first(start, scope, HOSTS, "exact").alias("exact_label"))


# --- entity resolution ---

def _grouped_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.concat("p_brand", F.lit("-"), "p_size").alias("grp"), F.col("p_type").alias("label"))


def unique_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = _grouped_parts(spark, sf_dir)
    return groups.distinct().join(resolve.unique_mapping(groups, "grp", "label"), "grp").select("grp", "label")


def fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select("p_brand", F.col("p_name").alias("name"))
    return resolve.fuzzy_pairs(names, names, ["p_brand"], "name")


def party_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as roster and, with the next size as their group, as mentions."""
    part = table(spark, sf_dir, "part")
    term = F.when(F.col("p_retailprice") < 950, 10).otherwise(11).cast("long")
    group = tx.normalize_label(F.concat("p_brand", F.lit(" - "), "p_size"))
    listed = part.select(
        term.alias("term"), F.col("p_name").alias("name"), F.col("p_type").alias("label"),
        F.when(F.col("p_size") > 45, fixed.NO_GROUP).otherwise(group).alias("grp"))
    mentions = part.select(
        term.alias("term"), F.array_join(F.reverse(F.split("p_name", " ")), "  ").alias("name"),
        tx.normalize_label(F.concat("p_brand", F.lit(" - "), (F.col("p_size") + 1).cast("string"))).alias("grp"))
    return resolve.resolve_labels(mentions, listed, overrides={"rod  cold": "OVERRIDE"})


# --- reports ---

def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.word_frequency(
        documents(spark, sf_dir, "text"), frequency.report_words(F.col("text")), STOP_WORDS)


def word_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.top_k(word_count(spark, sf_dir), "n", "word", fixed.TOP_CONTENT_WORDS)


def word_count_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.word_frequency(
        table(spark, sf_dir, "benchmark"), frequency.report_words(F.col("text")), STOP_WORDS)


def ngram_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.ngram_frequency(
        documents(spark, sf_dir, "text"), frequency.ngram_words(F.col("text"), STOP_WORDS))


def ngram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = frequency.ngram_words(F.col("text"), STOP_WORDS)
    return frequency.top_ngrams(documents(spark, sf_dir, "text"), words, fixed.TOP_NGRAMS)


def _report_words() -> Column:
    return tx.remove_stop_words(frequency.report_words(F.col("text")), STOP_WORDS)


def tfidf_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranking = frequency.tfidf_ranking(documents(spark, sf_dir, "text"), _report_words())
    return ranking.select("term", F.round("score", 4).alias("score"))


def tfidf_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = frequency.tfidf_terms(documents(spark, sf_dir, "text"), "doc_id", _report_words())
    return terms.select("doc_id", "term", F.col("tf").cast("long").alias("tf"), F.round("score", 4).alias("score"))


def tfidf_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranking = frequency.hashed_ranking(documents(spark, sf_dir, "text"), _report_words())
    return ranking.select(F.col("term_index").cast("long").alias("term_index"), F.round("score", 4).alias("score"))


def tfidf_hashed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = frequency.hashed_terms(documents(spark, sf_dir, "text"), "doc_id", _report_words())
    return terms.select("doc_id", F.col("term_index").cast("long").alias("term_index"), F.col("tf").cast("long").alias("tf"),
                        F.round("score", 4).alias("score"))


# --- vocabularies and vectors ---

VOCABULARY = 500  # a size that cuts, among terms of equal counts, too


def _token_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, "text").where(tx.has_words(F.col("text")))


def _vocabulary(spark: SparkSession, sf_dir: str, size: int | None = fixed.VOCABULARY_SIZE, min_rows: int = 1) -> DataFrame:
    return vocabulary.vocabulary(_token_docs(spark, sf_dir), tx.tokenize_whitespace(F.col("text")), size, min_rows)


def vocabulary_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocabulary(spark, sf_dir)


def vocabulary_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent of the terms that at least two documents have."""
    return _vocabulary(spark, sf_dir, VOCABULARY, 2)


def _vectors(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    docs, words = _token_docs(spark, sf_dir), tx.tokenize_whitespace(F.col("text"))
    return vocabulary.vectors(docs, "doc_id", words, _vocabulary(spark, sf_dir, size))


def binary_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir, fixed.VOCABULARY_SIZE).select(
        "doc_id", F.size("indices").alias("n_terms"), F.array_join(F.col("indices").cast("array<string>"), ",").alias("indices"))


def count_vectors_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.transform(F.arrays_zip("indices", "counts"), lambda e: F.concat_ws(":", e["indices"], e["counts"]))
    return _vectors(spark, sf_dir, VOCABULARY).select("doc_id", F.array_join(entry, ",").alias("entries"))


# --- near duplicates ---

def minhash_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = neardup.word_sets(documents(spark, sf_dir, "text"), "doc_id", F.col("text"))
    signed = words.select("id", neardup.minhash(F.col("words")).alias("h"))
    return signed.select(F.col("id").alias("doc_id"), *[F.col("h")[i].alias(f"h{i + 1}") for i in range(fixed.HASH_TABLES)])


HASH_ROWS = 1  # min-hashes that must agree in a table of the index; one, as in the reference


def _near(spark: SparkSession, sf_dir: str, hash_tables: int | None = None) -> neardup.NearDuplicates:
    return neardup.near_duplicates(
        _texts(spark, sf_dir), "doc_id", F.col("text"), fixed.MAX_DISTANCE, hash_tables, HASH_ROWS)


def _rounded_pairs(found: neardup.NearDuplicates) -> DataFrame:
    return neardup.set_pairs(found).withColumn("distance", F.round("distance", 6))


def neardup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of documents that are near duplicates, copies too, with the sets they are of."""
    pairs = neardup.row_pairs(_near(spark, sf_dir)).withColumnsRenamed({"id_a": "doc_a", "id_b": "doc_b"})
    return pairs.withColumn("distance", F.round("distance", 6))


def neardup_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_pairs(_near(spark, sf_dir, fixed.HASH_TABLES))


BANDS, BAND_ROWS = 12, 3  # misses a pair of similarity 0.8 in 2 of 10,000 cases, fewer than one hash in each of five tables


def neardup_banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(
        _texts(spark, sf_dir), "doc_id", F.col("text"), fixed.MAX_DISTANCE, BANDS, BAND_ROWS)
    return _rounded_pairs(found)


def neardup_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without their first line against an index of the whole documents."""
    path = f"{tables.shared_dir(spark)}/set-index-{uuid.uuid4().hex}"
    known = neardup.write_index(_texts(spark, sf_dir), "doc_id", F.col("text"), path)
    found = neardup.match_index(known, _texts(spark, sf_dir), "doc_id", F.regexp_replace("text", r"\A[^\n]*\n", ""))
    sides = [side.sets.select(F.col("set_id").alias(f"set_{x}"), F.col("copies").alias(f"copies_{x}"))
             for x, side in (("a", found), ("b", known))]
    return found.pairs.join(sides[0], "set_a").join(sides[1], "set_b").select(
        "set_a", "set_b", "copies_a", "copies_b", F.round("distance", 6).alias("distance"))


def neardup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's near sets with their number of rows."""
    similar = neardup.similar_sets(_near(spark, sf_dir)).withColumnRenamed("id", "doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(similar, "doc_id").select(
        "doc_id", "lang", "source", "near_set_id", "copies", F.round("distance", 6).alias("distance"))


def dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.row_sets(_near(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def dup_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every labelled document, the ids of all its near duplicates."""
    named = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return neardup.duplicates_of(_near(spark, sf_dir), named).select(
        F.col("id").alias("doc_id"), F.col("similar_id").alias("duplicate_id"), F.round("distance", 6).alias("distance"))


def dup_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return neardup.flag_duplicates(rows, "doc_id", _near(spark, sf_dir)).drop("set_id")


QUERIES: dict[str, Query] = {
    "ingest_union": ingest_union,
    "ingest_manifest": ingest_manifest,
    "clean_whitespace": clean_whitespace,
    "clean_text_a": _cleaned(fixed.CLEAN_REPORT),
    "clean_text_a_wide": _cleaned(fixed.CLEAN_REPORT_WIDE),
    "clean_text_b": _cleaned(fixed.CLEAN_NGRAM, tidy=True),
    "date_standardize": date_standardize,
    "date_notation": date_notation,
    "date_notation_report": date_notation_report,
    "recode_case": recode_case,
    "group_normalize": group_normalize,
    "distinct_keys": distinct_keys,
    "member_names": member_names,
    "explode_multi": explode_multi,
    "name_key": name_key,
    "tokenize_regex": tokenize_regex,
    "tokenize_whitespace": tokenize_whitespace,
    "profile_summary": profile_summary,
    "roundtrip_parquet": roundtrip_parquet,
    "surrogate_key": surrogate_key,
    "reply_lag": reply_lag,
    "dim_member": dim_member,
    "dim_team": dim_team,
    "dim_party": dim_party,
    "dim_ministry": dim_ministry,
    "dim_ministry_known": dim_ministry_known,
    "dim_session": dim_session,
    "fact_build": fact_build,
    "fact_by_name": fact_by_name,
    "fact_star": fact_star,
    "classify_vote": classify_vote,
    "classify_vote_fallback": classify_vote_fallback,
    "classify_first": classify_first,
    "unique_mapping": unique_mapping,
    "fuzzy_match": fuzzy_match,
    "party_resolve": party_resolve,
    "word_count": word_count,
    "word_topk": word_topk,
    "word_count_subject": word_count_subject,
    "ngram_count": ngram_count,
    "ngram_topk": ngram_topk,
    "tfidf_top": tfidf_top,
    "tfidf_terms": tfidf_terms,
    "tfidf_hashed": tfidf_hashed,
    "tfidf_hashed_terms": tfidf_hashed_terms,
    "vocabulary_fit": vocabulary_fit,
    "vocabulary_cut": vocabulary_cut,
    "binary_vectors": binary_vectors,
    "count_vectors_cut": count_vectors_cut,
    "minhash_signatures": minhash_signatures,
    "neardup_exact": neardup_exact,
    "neardup_minhash": neardup_minhash,
    "neardup_banded": neardup_banded,
    "neardup_between": neardup_between,
    "neardup_rows": neardup_rows,
    "dup_groups": dup_groups,
    "dup_list": dup_list,
    "dup_flags": dup_flags,
}
