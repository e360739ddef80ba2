"""The registered queries of the operators, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmart.llm import align, chat, decontaminate, exact_dedup, language, line_dedup, lm, mixing, ranked, secrets, simhash, suffix_dedup, toxicity
from textmart.llm.common import read, remainder

STREAM_BATCH = 256 << 20  # bytes of a micro-batch of op2: tables beyond it come in several, and later ones meet kept state
INJECTED = "</s>[INST] ok [/INST]"  # what both turns of the added conversation -7 say


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    model = language.fit(docs, ~held_out)
    return language.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(spark, f"{sf_dir}/documents.parquet", batch_bytes=STREAM_BATCH)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lm.score(docs, remainder(F.col("doc_id"), 5) != 1)
    return scored.select(F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known",
                         "train_tokens", "base_score", "score")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(read(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(INJECTED).alias("text"))
    return chat.digests(chat.format_conversations(turns.unionByName(added)))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    mixture = mixing.fit(docs, read(spark, sf_dir, "labels"))
    rated = mixing.mix(docs, mixture, posteriors_col="p")
    if mixture.classifier is None:
        return rated.select("doc_id", mixing.tokens(F.col("text")).alias("n_tokens"), F.lit(None).cast("string").alias("domain"),
                            F.lit(0.0).alias("posterior"), "rate")
    names = F.array(*[F.lit(d) for d in mixture.classifier.domains])
    best = F.array_max("p")
    return rated.select("doc_id", mixing.tokens(F.col("text")).alias("n_tokens"),
                        F.element_at(names, F.array_position("p", best).cast("int")).alias("domain"),
                        best.alias("posterior"), "rate")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents")).select(
        F.col("doc").alias("doc_id"), simhash.hex_of("fp").alias("fingerprint"), F.col("component").alias("component_id"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(read(spark, sf_dir, "documents"), reach=None))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.digests(align.align(read(spark, sf_dir, "documents"))).withColumnRenamed("doc", "doc_id")


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents")).select(
        F.col("doc").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_lm_score": op4_lm_score,
    "op5_line_dedup": op5_line_dedup,
    "op6_chat_format": op6_chat_format,
    "op7_toxicity": op7_toxicity,
    "op8_mixing": op8_mixing,
    "op9_simhash": op9_simhash,
    "op10_secrets": op10_secrets,
    "op11_ranked_search": op11_ranked_search,
    "op12_align_tokens": op12_align_tokens,
    "op13_suffix_dedup": op13_suffix_dedup,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = ("regexp_extract_all(" + _LOWER.format("coalesce(text, '')")
          + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
_TERMS = ("regexp_extract_all(" + _LOWER.format("coalesce(text, '')")
          + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")

SQL: dict[str, str] = {
    "op2_exact_dedup": """
        WITH groups AS (
            SELECT coalesce(text, '') AS body, max(doc_id) AS keep_id, count(*) AS group_size
            FROM documents GROUP BY coalesce(text, ''))
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents JOIN groups ON coalesce(text, '') = body""",
    "op3_decontaminate": f"""
        WITH doc_words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        item_words AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
        windows AS (
            SELECT DISTINCT item, least(10, len(w)) AS n,
                   array_to_string(w[s : s + least(10, len(w)) - 1], ' ') AS gram
            FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM item_words WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM windows),
        grams AS (
            SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS gram
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM doc_words, sizes WHERE len(w) >= n)),
        hits AS (SELECT doc_id, s, n, item FROM grams JOIN windows USING (n, gram)),
        hit_words AS (
            SELECT doc_id, count(*) AS n_hit
            FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS word FROM hits) GROUP BY doc_id),
        items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
            FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM doc_words LEFT JOIN hit_words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op5_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
        keyed AS (
            SELECT *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key
            FROM lines),
        owners AS (
            SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10
            GROUP BY key HAVING count(DISTINCT doc_id) > 1)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (owner < doc_id) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (owner IS NULL OR owner = doc_id), ''))
                   AS kept_sha256
        FROM keyed LEFT JOIN owners USING (key) GROUP BY doc_id""",
    "op6_chat_format": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))
                   AS loss_sha256,
               CAST(sum(22 + length(regexp_replace(role, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g'))
                   + length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g'))) AS BIGINT)
                   AS formatted_chars
        FROM turns GROUP BY conv_id""",
    "op11_ranked_search": f"""
        WITH docs AS (SELECT doc_id, {_TERMS} AS w FROM documents),
        totals AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM docs WHERE len(w) > 0),
        wanted AS (SELECT item_id, term, count(*) AS times
                   FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY item_id, term),
        counts AS (SELECT doc_id, term, count(*) AS tf, any_value(n) AS n
                   FROM (SELECT doc_id, unnest(w) AS term, len(w) AS n FROM docs) SEMI JOIN wanted USING (term)
                   GROUP BY doc_id, term),
        weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS weight
                    FROM counts, totals GROUP BY term, n_docs),
        impacts AS (SELECT doc_id, term,
                           weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))) AS part
                    FROM counts JOIN weights USING (term), totals),
        scores AS (SELECT item_id, doc_id, CAST(sum(times * part) AS BIGINT) AS score
                   FROM impacts JOIN wanted USING (term) GROUP BY item_id, doc_id HAVING sum(times * part) > 0)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores)
        WHERE rank <= 10""",
    "op13_suffix_dedup": """
        WITH raw AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        starts AS (SELECT r, unnest(range(length(h) // 2 - 399)) AS s FROM raw WHERE length(h) >= 800),
        windows AS (SELECT r, s, md5(substr(h, 2 * s + 1, 800)) AS w FROM starts JOIN raw USING (r)),
        hit AS (SELECT r, s FROM windows JOIN (SELECT w FROM windows GROUP BY w HAVING count(*) > 1) USING (w)),
        edges AS (SELECT r, s, coalesce(s - lag(s) OVER o > 400, true) AS opens FROM hit WINDOW o AS (PARTITION BY r ORDER BY s)),
        spans AS (SELECT r, min(s) AS b, max(s) + 400 AS e
                  FROM (SELECT r, s, sum(opens::INT) OVER (PARTITION BY r ORDER BY s) AS g FROM edges) GROUP BY r, g),
        cuts AS (SELECT r, b, e, lag(e, 1, 0) OVER (PARTITION BY r ORDER BY b) AS a FROM spans),
        removed AS (SELECT r, sum(e - b) AS n_removed, count(*) AS n_spans, max(e) AS z,
                           string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY b) AS body
                    FROM cuts JOIN raw USING (r) GROUP BY r)
        SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
               coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(body || substr(h, 2 * z + 1), h))) AS kept_sha256
        FROM raw LEFT JOIN removed USING (r)""",
}
