"""The question mart: from source files to star schema, reports and duplicate flags.

Each step takes and returns DataFrames. `run` chains them over folders, writing every table once
and reading it back, so no step recomputes another.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmart.functions import fixed_values as fixed
from textmart.functions import text as tx
from textmart.functions.dates import days_to_reply, is_replied
from textmart.operators import classify, frequency, neardup, star
from textmart.operators.ids import assign_ids
from textmart.operators.joins import lookup
from textmart.operators.resolve import resolve_labels
from textmart.sources import manifest
from textmart.sources.tables import materialize, read_table, scratch, spread, write_table

# The columns of the question table, their other names in some sources; the columns of the
# fact table are in build_facts.
QUESTIONS = T.StructType([
    T.StructField("numero", T.LongType()),
    T.StructField("legislation_id", T.LongType()),
    T.StructField("periode", T.StringType()),
    T.StructField("question_type", T.StringType()),
    T.StructField("question_nature", T.StringType()),
    T.StructField("depute", T.StringType()),
    T.StructField("groupe", T.StringType()),
    T.StructField("date_depot", T.StringType()),
    T.StructField("ministere", T.StringType()),
    T.StructField("sujet", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("date_reponse", T.StringType()),
])
QUESTION_ALIASES = {"question": ["observation"], "question_nature": ["type"]}
QUESTION_REQUIRED = ["question", "numero"]
QUESTION_DATES = ("date_depot", "date_reponse")
GROUP_CONSTANTS = {"question_type": "type", "legislation_id": "legislation"}

# A question's place in the order of question ids: by date, then by what tells questions apart.
QUESTION_ORDER = ["date_depot", "legislation_id", "question_type", "numero"]


def ingest_questions(spark: SparkSession, manifest_path: str, folder: str, date_formats: Sequence[str] = (),
                     on_unfit: str = "raise", multi_line: bool = True) -> DataFrame:
    """The question table from the manifest's files. Texts of questions have line breaks: see `read_files`."""
    groups = manifest.load_manifest(spark, manifest_path, folder, GROUP_CONSTANTS)
    return manifest.ingest_files(
        spark, groups, QUESTIONS, lambda s, paths: manifest.read_files(s, paths, multi_line),
        aliases=QUESTION_ALIASES, required=QUESTION_REQUIRED,
        dates={c: date_formats for c in QUESTION_DATES}, on_unfit=on_unfit)


def roster(elected: DataFrame, terms: Mapping[str, int] = fixed.TERMS) -> DataFrame:
    """The elected members of `terms`, as (term, name, grp, label)."""
    term = F.coalesce(*[F.when(F.col("parlement") == period, number) for period, number in terms.items()])
    return elected.where(F.col("parlement").isin(list(terms))).select(
        term.cast("long").alias("term"), F.col("prenomNomAR").alias("name"),
        tx.normalize_label(F.col("groupeAR")).alias("grp"), F.col("parti").alias("label"))


def parties(listed: DataFrame) -> DataFrame:
    return listed.select(F.col("label").alias("parti")).distinct()


def party_groups(listed: DataFrame) -> DataFrame:
    return listed.where(F.col("grp") != fixed.NO_GROUP).select(
        F.col("term").alias("parlement"), F.col("grp").alias("groupeAR"), F.col("label").alias("parti")).distinct()


def member_mentions(questions: DataFrame) -> DataFrame:
    """One row per question and member named in it, with clean names: depute, groupe."""
    cleaned = questions.withColumn("groupe", tx.normalize_label(F.col("groupe")))
    return star.explode_members(cleaned, "depute", tx.split_multi(F.col("depute"))).withColumn(
        "depute", tx.apply_rules(F.col("depute"), fixed.MEMBER_RULES))


def member_parties(questions: DataFrame, listed: DataFrame, ambiguous: str = "best",
                   overrides: Mapping[str, str] = fixed.PARTY_OVERRIDES) -> DataFrame:
    """The party of every (depute, groupe, legislation_id) named in the questions."""
    mentions = member_mentions(questions).select(
        F.col("depute").alias("name"), F.col("groupe").alias("grp"), F.col("legislation_id").alias("term"))
    return resolve_labels(mentions, listed, ambiguous, overrides).select(
        F.col("name").alias("depute"), F.col("grp").alias("groupe"), F.col("term").alias("legislation_id"),
        F.col("label").alias("party_code"), "method", "candidates")


def classify_questions(questions: DataFrame, sectors: classify.Keywords, fixed_sectors: classify.Keywords,
                       ministries: Mapping[object, classify.Keywords]) -> DataFrame:
    """The questions with sector and ministry_classified, in one pass."""
    ministry = F.col("ministere")
    return questions.withColumns({
        "sector": classify.classify_vote(
            [F.col("sujet"), F.col("question")], sectors, gate=ministry, fallback=fixed_sectors),
        "ministry_classified": classify.classify_first(ministry, F.col("legislation_id"), ministries),
    })


@dataclass(frozen=True)
class Dimensions:
    member: DataFrame
    team: DataFrame
    party: DataFrame
    ministry: DataFrame
    session: DataFrame
    # Members with their labels: what facts are matched against.
    member_labels: DataFrame


def people(questions: DataFrame) -> DataFrame:
    """The distinct members named in the questions."""
    return member_mentions(questions).select(
        F.col("depute").alias("deputy_name"), F.col("groupe").alias("deputy_team"), "legislation_id").distinct()


def labelled_people(questions: DataFrame, parties_of: DataFrame) -> DataFrame:
    """The members with deputy_id and deputy_party_code; a member of several parties has several rows."""
    numbered = assign_ids(people(questions), ["legislation_id", "deputy_team", "deputy_name"], "deputy_id")
    codes = materialize(parties_of.select(
        F.col("depute").alias("deputy_name"), F.col("groupe").alias("deputy_team"), "legislation_id",
        F.col("party_code").alias("deputy_party_code")), "party-codes")
    return materialize(lookup(numbered, codes, ["deputy_name", "deputy_team", "legislation_id"]), "members")


def question_values(questions: DataFrame) -> dict[str, DataFrame]:
    """What the dimensions of the questions themselves are made of."""
    return {
        "ministry": questions.select(F.col("ministry_classified").alias("ministry_name")),
        "session": questions.select(F.col("periode").alias("session_label")),
    }


def build_dimensions(questions: DataFrame, parties_of: DataFrame) -> Dimensions:
    """The five dimensions. `parties_of` gives the party_code of (depute, groupe, legislation_id)."""
    members = labelled_people(questions, parties_of)
    dims = star.build_dims({
        "deputy_party": members.select("deputy_party_code"),
        "deputy_team": members.select(F.col("deputy_team").alias("deputy_team_name")),
        **question_values(questions),
    })
    labelled = materialize(star.star_join(members, [
        star.Dimension(dims["deputy_team"], {"deputy_team": "deputy_team_name"}, ["deputy_team_id"], "left"),
        star.Dimension(dims["deputy_party"], {"deputy_party_code": "deputy_party_code"}, ["deputy_party_id"], "left"),
    ]), "member-labels")
    member = labelled.select("deputy_id", "deputy_name", "deputy_team_id", "deputy_party_id", "legislation_id")
    return Dimensions(member, dims["deputy_team"], dims["deputy_party"], dims["ministry"], dims["session"], labelled)


FULL_MEMBER_KEY = {"depute": "deputy_name", "groupe": "deputy_team", "legislation_id": "legislation_id"}
NAME_ONLY_KEY = {"depute": "deputy_name"}


def build_facts(questions: DataFrame, dims: Dimensions, member_key: Mapping[str, str] = FULL_MEMBER_KEY,
                order_by: Sequence[str] = QUESTION_ORDER, how: str = "inner") -> DataFrame:
    """One row per question and member, with the ids of its dimensions and the reply measures.

    Questions whose member, ministry or session is in no dimension are left out; with how="left" they
    are kept, with null ids. With NAME_ONLY_KEY a member named in several teams or terms gives several
    rows. Questions that tie in `order_by` are numbered in the order of a hash of all their columns.
    """
    numbered = assign_ids(questions, [*order_by, F.xxhash64(*questions.columns)], "question_id")
    facts = star.star_join(member_mentions(numbered), [
        star.Dimension(dims.member_labels, dict(member_key), ["deputy_id", "deputy_team_id", "deputy_party_id"], how),
        star.Dimension(dims.ministry, {"ministry_classified": "ministry_name"}, ["ministry_id"], how),
        star.Dimension(dims.session, {"periode": "session_label"}, ["session_id"], how),
    ])
    asked, replied = F.col("date_depot"), F.col("date_reponse")
    return facts.select(
        "question_id", F.col("numero").alias("question_number"), "legislation_id", "session_id",
        "question_nature", "question_type", "deputy_id", "deputy_team_id", "deputy_party_id", "ministry_id",
        asked.alias("question_ask_date"), F.col("sujet").alias("question_subject"),
        F.col("question").alias("question_content"), F.col("sector").alias("question_sector"),
        is_replied(replied).alias("question_is_replied"), replied.alias("question_reply_date"),
        days_to_reply(replied, asked).alias("question_days_to_reply"))


def one_row_per_question(facts: DataFrame) -> DataFrame:
    """Question texts without the repetition per member."""
    return facts.select("question_id", "question_subject", "question_content").distinct()


def word_report(facts: DataFrame, column: str, stop_words: Sequence[str], k: int,
                drop: str = fixed.CLEAN_REPORT) -> DataFrame:
    """The k most frequent words of a fact column, counted per fact row."""
    words = frequency.report_words(F.col(column), drop)
    stops = [*stop_words, *fixed.REPORT_STOP_WORDS]
    return frequency.top_k(frequency.word_frequency(facts, words, stops), "n", "word", k)


def tfidf_report(facts: DataFrame, stop_words: Sequence[str], drop: str = fixed.CLEAN_REPORT) -> DataFrame:
    words = tx.remove_stop_words(
        frequency.report_words(F.col("question_content"), drop), [*stop_words, *fixed.REPORT_STOP_WORDS])
    return frequency.tfidf_ranking(facts, words)


def ngram_report(facts: DataFrame, stop_words: Sequence[str], k: int = fixed.TOP_NGRAMS) -> DataFrame:
    stops = [*stop_words, *fixed.REPORT_STOP_WORDS, *fixed.NGRAM_STOP_WORDS]
    words = frequency.ngram_words(F.col("question_content"), stops)
    return frequency.top_ngrams(facts, words, k)


def find_duplicates(facts: DataFrame, max_distance: float = fixed.MAX_DISTANCE,
                    hash_tables: int | None = None, hash_rows: int = 1) -> neardup.NearDuplicates:
    texts = spread(materialize(one_row_per_question(facts), "question-texts"), "question_id")
    return neardup.near_duplicates(texts, "question_id", F.col("question_content"), max_distance, hash_tables, hash_rows)


def duplicate_questions(facts: DataFrame, found: neardup.NearDuplicates) -> DataFrame:
    """Each fact once per set of texts near its question's: its columns, near_set_id, near_questions, JaccardDistance.

    `near_questions` is the number of questions in the near set, the question itself included in its own set;
    `neardup.duplicates_of` lists the ids for chosen questions.
    """
    similar = neardup.similar_sets(found).select(
        F.col("id").alias("question_id"), "near_set_id", F.col("copies").alias("near_questions"),
        F.col("distance").alias("JaccardDistance"))
    return facts.join(similar, "question_id").select(*facts.columns, "near_set_id", "near_questions", "JaccardDistance")


def flag_facts(facts: DataFrame, found: neardup.NearDuplicates) -> DataFrame:
    """The facts with duplicate_set_id, duplicate_question_count and is_duplicate."""
    flags = materialize(neardup.row_sets(found).select(
        F.col("id").alias("question_id"), F.col("set_id").alias("duplicate_set_id"),
        F.col("duplicate_count").alias("duplicate_question_count"), F.lit(1).alias("is_duplicate")), "duplicates")
    return facts.join(flags, "question_id", "left").na.fill(0, ["duplicate_question_count", "is_duplicate"])


@dataclass(frozen=True)
class Inputs:
    """What a run needs: paths and dictionaries."""

    manifest: str
    folder: str
    elected: DataFrame
    sectors: classify.Keywords
    fixed_sectors: classify.Keywords
    ministries: Mapping[object, classify.Keywords]
    stop_words: Sequence[str] = field(default_factory=list)
    date_formats: Sequence[str] = field(default_factory=list)
    # What to do with a number or date that cannot be read: raise, or null.
    on_unfit: str = "raise"
    # Whether cells of CSV files may hold line breaks.
    multi_line: bool = True
    # Characters the word reports drop; CLEAN_REPORT_WIDE is the unescaped range.
    report_cleaner: str = fixed.CLEAN_REPORT


def run(spark: SparkSession, inputs: Inputs, out: str) -> dict[str, DataFrame]:
    """Build every table of the mart under `out` and return them by name.

    Intermediate tables lie in a folder beside them, which is deleted at the end.
    """
    with scratch(spark, out):
        return _run(spark, inputs, out)


def _run(spark: SparkSession, inputs: Inputs, out: str) -> dict[str, DataFrame]:
    tables: dict[str, DataFrame] = {}

    def keep(name: str, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        write_table(df, f"{out}/{name}", partition_by)
        tables[name] = read_table(spark, f"{out}/{name}", df.schema)
        return tables[name]

    questions = keep("questions", ingest_questions(
        spark, inputs.manifest, inputs.folder, inputs.date_formats, inputs.on_unfit, inputs.multi_line))
    listed = materialize(roster(inputs.elected), "roster")
    keep("parties", parties(listed))
    keep("parties_groups", party_groups(listed))
    codes = keep("deputies_parties", member_parties(questions, listed))
    classified = keep("classified_questions", classify_questions(
        questions, inputs.sectors, inputs.fixed_sectors, inputs.ministries))
    dims = build_dimensions(classified, codes)
    for name, table in (("deputy_dim", dims.member), ("deputy_team_dim", dims.team), ("deputy_party_dim", dims.party),
                        ("ministry_dim", dims.ministry), ("session_dim", dims.session)):
        keep(name, table)
    facts = keep("question_fact", build_facts(classified, dims), ["legislation_id"])
    drop = inputs.report_cleaner
    keep("content_words", word_report(facts, "question_content", inputs.stop_words, fixed.TOP_CONTENT_WORDS, drop))
    keep("subject_words", word_report(facts, "question_subject", inputs.stop_words, fixed.TOP_SUBJECT_WORDS, drop))
    keep("content_tfidf", tfidf_report(facts, inputs.stop_words, drop))
    keep("content_ngrams", ngram_report(facts, inputs.stop_words))
    found = find_duplicates(facts)
    keep("duplicate_sets", found.sets)
    keep("duplicate_members", found.members)
    keep("duplicate_set_pairs", neardup.set_pairs(found))
    keep("duplicate_questions_lhs", duplicate_questions(facts, found))
    keep("question_fact_duplicates", flag_facts(facts, found), ["legislation_id"])
    return tables
