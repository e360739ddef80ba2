"""The registered queries in SQL, written from their meaning, to check the Spark results against."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from textmart.plans import catalogue as c

GAPS = r"""[\s\-,"؛،.ـ_:]"""


def _quoted(text: object) -> str:
    return "'" + str(text).replace("'", "''") + "'"


def _strings(values: Sequence[str]) -> str:
    return ", ".join(_quoted(v) for v in values)


def _dictionary(entries: Mapping[str, Sequence[str]]) -> str:
    rows = [f"({i}, {_quoted(label)}, {_quoted(k)})" for i, (label, ks) in enumerate(entries.items()) for k in ks]
    return f"(VALUES {', '.join(rows)}) AS t(ord, label, kw)"


def _scoped(scopes: Mapping[object, Mapping[str, Sequence[str]]]) -> str:
    rows = []
    for scope, labels in scopes.items():
        flat = [(label, k) for label, ks in labels.items() for k in ks]
        rows += [f"({_quoted(scope)}, {i}, {_quoted(label)}, {_quoted(k)})" for i, (label, k) in enumerate(flat)]
    return f"(VALUES {', '.join(rows)}) AS t(scope, ord, label, kw)"


def _replaced(expr: str, *rules: tuple[str, str]) -> str:
    for pattern, by in rules:
        expr = f"regexp_replace({expr}, {_quoted(pattern)}, {_quoted(by)}, 'g')"
    return expr


ARTICLES = [(" وال", " ال"), (" ال ", " ")]
CLEAN_A = _replaced("text", (r"[⸮():.,\-؛،ـ_؟]", " "), *ARTICLES)
CLEAN_WIDE = _replaced("text", (r"[⸮\(\):\.,-؛،ـ_؟]", " "), *ARTICLES)
CLEAN_B = "trim(" + _replaced("text", (r'[⸮–()•\\/\d":.,\-؛،ـ_؟]', " "), *ARTICLES, (r"\s+", " ")) + ")"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '{GAPS}'), lambda w: w <> '')"


STOPS = _strings([w.lower() for w in c.STOP_WORDS])
REPORT = f"list_filter({_words(CLEAN_A)}, lambda w: w NOT IN ({STOPS}))"


def _label(expr: str) -> str:
    spaced = _replaced(expr, ("-", " "), ("  ", " "))
    return _replaced(f"trim({spaced})", ("وال", "و ال"))


def _squeeze(expr: str) -> str:
    return "trim(" + _replaced(f"trim({expr})", (r"\s+", " ")) + ")"


def _key(expr: str, rules: Sequence[tuple[str, str]]) -> str:
    changed = _replaced(_squeeze(expr), *rules)
    return _squeeze(f"array_to_string(list_sort(string_split({changed}, ' ')), ' ')")


ARABIC_RULES = [("عبب?د ال", "عبدال"), ("[آأإ]", "ا"), ("[ئى]", "ي"), ("ال", ""), ("مولاي", "")]
MEMBER_RULES = [("بلافريج عمر", "عمر بلافريج"), ("^فيقة لشرف$", "شفيقة لشرف")]
LATIN_RULES = [("[éèêë]", "e"), ("[àâä]", "a"), ("[öô]", "o"), ("[.,]", "")]

# --- questions, dimensions, facts ---

QUESTIONS = f"""
lines AS (
    SELECT l_orderkey, min(l_shipdate) AS shipped FROM lineitem GROUP BY l_orderkey),
questions AS (
    SELECT o_orderkey AS numero,
           CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 10 ELSE 11 END AS legislation_id,
           strftime(o_orderdate, '%Y-%m') AS periode, o_orderstatus AS question_type,
           o_orderpriority AS question_nature,
           list_filter([c_name, s_name], lambda m: m IS NOT NULL) AS members,
           {_label("replace(n_name, '_', ' - ')")} AS groupe,
           CASE WHEN n_regionkey > 0 THEN r_name END AS party,
           o_orderdate AS asked, c_mktsegment AS segment,
           CASE WHEN shipped >= o_orderdate THEN shipped END AS replied
    FROM orders LEFT JOIN lines ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey
         JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
         LEFT JOIN supplier ON c_nationkey = s_suppkey),
aliases AS (SELECT * FROM {_scoped(c.MINISTRIES)}),
classified AS (
    SELECT q.*, m.label AS ministry FROM questions q LEFT JOIN (
        SELECT numero, min_by(label, ord) AS label FROM questions
        JOIN aliases ON scope = legislation_id::VARCHAR AND contains('Ministry of ' || segment, kw) GROUP BY numero) m
    ON q.numero = m.numero),
mentions AS (SELECT *, unnest(members) AS depute FROM classified),
people AS (
    SELECT row_number() OVER (ORDER BY legislation_id, groupe, depute) AS deputy_id, * FROM (
        SELECT DISTINCT depute, groupe, legislation_id, party FROM mentions)),
team AS (SELECT row_number() OVER (ORDER BY groupe NULLS FIRST) AS team_id, groupe FROM (SELECT DISTINCT groupe FROM people)),
party AS (SELECT row_number() OVER (ORDER BY party NULLS FIRST) AS party_id, party FROM (SELECT DISTINCT party FROM people)),
member AS (
    SELECT deputy_id, depute, people.groupe, legislation_id, team_id, party_id
    FROM people LEFT JOIN team ON people.groupe = team.groupe LEFT JOIN party ON people.party = party.party),
ministry AS (
    SELECT row_number() OVER (ORDER BY ministry NULLS FIRST) AS ministry_id, ministry
    FROM (SELECT DISTINCT ministry FROM classified)),
session AS (SELECT row_number() OVER (ORDER BY periode) AS session_id, periode FROM (SELECT DISTINCT periode FROM classified)),
numbered AS (SELECT *, row_number() OVER (ORDER BY asked, numero) AS question_id FROM classified)
"""

FACT_SOURCE = """(SELECT *, unnest(members) AS depute FROM numbered) n
    JOIN ministry ON n.ministry = ministry.ministry JOIN session ON n.periode = session.periode"""

# --- near duplicates ---

WORD_SETS = r"""
docs AS (
    SELECT doc_id, list_sort(list_distinct(regexp_split_to_array(
        rtrim(lower(text), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '\s'))) AS w
    FROM documents WHERE text = '' OR regexp_matches(text, '\S'))
"""
def _signature(number: int) -> str:
    prime = 2038074743
    family = [(pow(5, 3 * i + 11, prime), pow(7, 2 * i + 13, prime)) for i in range(number)]
    return ", ".join(
        f"list_min(list_transform(w, lambda x: (('0x' || substr(md5(x), 1, 7))::BIGINT * {a} + {b}) % {prime})) AS h{i}"
        for i, (a, b) in enumerate(family, 1))


def _pairs(source: str, key: str) -> str:
    """Pairs (a, b, distance) of rows of `source` that are closer than 0.2, in both directions."""
    return f"""
    terms AS (SELECT {key} AS id, len(w) AS n, unnest(w) AS word FROM {source}),
    shared AS (
        SELECT x.id AS a, y.id AS b, 1.0::DOUBLE - count(*)::DOUBLE / (any_value(x.n) + any_value(y.n) - count(*)) AS distance
        FROM terms x JOIN terms y ON x.word = y.word AND x.id <> y.id GROUP BY x.id, y.id),
    pairs AS (SELECT * FROM shared WHERE distance < 0.2::DOUBLE)"""


SETS = f"{WORD_SETS}, sets AS (SELECT min(doc_id) AS set_id, count(*) AS copies, w FROM docs GROUP BY w)"
SET_PAIRS = """
SELECT a AS set_a, b AS set_b, sa.copies AS copies_a, sb.copies AS copies_b, round(distance, 6) AS distance
FROM pairs JOIN sets sa ON a = sa.set_id JOIN sets sb ON b = sb.set_id WHERE a < b {agree}
UNION ALL
SELECT set_id, set_id, copies, copies, 0.0::DOUBLE FROM sets WHERE copies > 1
"""


def _minhash_pairs(tables: int, rows: int) -> str:
    agree = " OR ".join("(" + " AND ".join(f"ha.h{t * rows + r + 1} = hb.h{t * rows + r + 1}" for r in range(rows)) + ")"
                        for t in range(tables))
    signed = "ON b = sb.set_id JOIN signed ha ON a = ha.set_id JOIN signed hb ON b = hb.set_id"
    return f"""WITH {SETS}, {_pairs("sets", "set_id")}, signed AS (SELECT set_id, {_signature(tables * rows)} FROM sets)
        {SET_PAIRS.format(agree=f"AND ({agree})").replace("ON b = sb.set_id", signed)}"""


DUPLICATES = f"""WITH {WORD_SETS}, {_pairs("docs", "doc_id")},
found AS (SELECT a AS doc_id, count(*) AS n FROM pairs GROUP BY a)
"""


def _voting(texts: str, gated: bool) -> str:
    gate = "WHERE (doc_id, ord) IN (SELECT DISTINCT doc_id, ord FROM documents, words WHERE contains(source, kw))" if gated else ""
    return f"""
    words AS (SELECT * FROM {_dictionary(c.TOPICS)}),
    votes AS (SELECT doc_id, ord, label, count(*) AS n FROM documents, words WHERE {texts} GROUP BY ALL),
    best AS (SELECT doc_id, label FROM votes {gate} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, ord) = 1)"""


IN_TEXTS = "contains(lang, kw) OR contains(text, kw)"


def _first_label(text: str, match: str, order: str) -> str:
    return f"""(SELECT page_id, arg_min(label, {order}) AS label FROM scoped JOIN hosts USING (scope)
               WHERE {match.format(text=text)} GROUP BY page_id)"""


def _profile_row(column: str, numeric: bool = True) -> str:
    if not numeric:
        return f"""SELECT '{column}' AS "column", count({column}) AS count, NULL::DOUBLE AS mean, NULL::DOUBLE AS stddev,
            NULL::DOUBLE AS min, NULL::DOUBLE AS p25, NULL::DOUBLE AS p50, NULL::DOUBLE AS p75, NULL::DOUBLE AS max FROM lineitem"""
    quantiles = ", ".join(
        f"round(quantile_disc({column}, {q})::DOUBLE, 3) AS {name}" for q, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75")))
    return f"""SELECT '{column}' AS "column", count({column}) AS count, round(avg({column}), 3) AS mean,
        round(stddev_samp({column}), 3) AS stddev, round(min({column})::DOUBLE, 3) AS min, {quantiles},
        round(max({column})::DOUBLE, 3) AS max FROM lineitem"""


def _word_count(table: str) -> str:
    return f"SELECT word, count(*) AS n FROM (SELECT unnest({REPORT}) AS word FROM {table}) GROUP BY word"


NGRAMS = f"""
WITH docs AS (
    SELECT doc_id, list_filter(string_split({CLEAN_B}, ' '), lambda w: w <> '' AND w NOT IN ({_strings(c.STOP_WORDS)})) AS k
    FROM documents),
starts AS (SELECT k, unnest(generate_series(1, len(k) - 2)) AS i FROM docs WHERE len(k) >= 3),
grams AS (SELECT array_to_string(k[i:i + l - 1], ' ') AS ngram FROM starts, (VALUES (1), (2), (3)) AS t(l))
SELECT ngram, count(*) AS n FROM grams GROUP BY ngram
"""

TERMS = f"""
WITH docs AS (SELECT doc_id, {REPORT} AS words FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(words) AS term FROM docs) GROUP BY doc_id, term),
idf AS (SELECT term, ln(((SELECT count(*) FROM docs) + 1) / (count(*) + 1)) AS idf, sum(tf)::BIGINT AS total FROM tf GROUP BY term)
"""

BUCKETS = f"""
WITH docs AS (SELECT doc_id, list_transform({REPORT}, lambda w: ('0x' || substr(md5(w), 1, 7))::BIGINT % 10000) AS words FROM documents),
tf AS (SELECT doc_id, term_index, count(*) AS tf FROM (SELECT doc_id, unnest(words) AS term_index FROM docs) GROUP BY doc_id, term_index),
idf AS (SELECT term_index, ln(((SELECT count(*) FROM docs) + 1) / (count(*) + 1)) AS idf, sum(tf)::BIGINT AS total
        FROM tf GROUP BY term_index)
"""

RESOLVE = f"""
WITH listed AS (
    SELECT CASE WHEN p_retailprice < 950 THEN 10 ELSE 11 END AS term, p_name AS name, p_type AS label,
           CASE WHEN p_size > 45 THEN 'sans_groupe' ELSE {_label("p_brand || ' - ' || p_size")} END AS grp FROM part),
mentions AS (
    SELECT DISTINCT CASE WHEN p_retailprice < 950 THEN 10 ELSE 11 END AS term,
           array_to_string(list_reverse(string_split(p_name, ' ')), '  ') AS name,
           {_label("p_brand || ' - ' || (p_size + 1)")} AS grp FROM part),
single AS (
    SELECT grp FROM (SELECT DISTINCT grp, label FROM listed WHERE grp <> 'sans_groupe') GROUP BY grp HAVING count(*) = 1),
direct AS (
    SELECT m.*, l.label FROM mentions m
    LEFT JOIN (SELECT DISTINCT term, grp, label FROM listed WHERE grp IN (SELECT grp FROM single)) l
    ON m.grp = l.grp AND m.term = l.term),
hits AS (
    SELECT d.name, d.grp, d.term, l.label, min(levenshtein({_key("d.name", ARABIC_RULES)}, {_key("l.name", ARABIC_RULES)})) AS edits
    FROM direct d JOIN listed l ON d.term = l.term AND (d.grp = l.grp OR l.grp = 'sans_groupe')
    WHERE d.label IS NULL AND levenshtein({_key("d.name", ARABIC_RULES)}, {_key("l.name", ARABIC_RULES)}) <= 1
    GROUP BY ALL),
found AS (
    SELECT name, grp, term, arg_min(label, (edits, label)) AS label, count(DISTINCT label) AS candidates
    FROM hits GROUP BY name, grp, term)
SELECT d.name, d.grp, d.term,
       CASE WHEN d.name = 'rod  cold' THEN 'OVERRIDE' ELSE coalesce(d.label, f.label) END AS label,
       CASE WHEN d.name = 'rod  cold' THEN 'override' WHEN d.label IS NOT NULL THEN 'group'
            WHEN f.label IS NOT NULL THEN 'name' END AS method,
       coalesce(candidates, 0) AS candidates
FROM direct d LEFT JOIN found f ON d.name = f.name AND d.grp = f.grp AND d.term = f.term
"""

def _vocabulary(size: int, min_rows: int = 1) -> str:
    return rf"""
    token_docs AS (
        SELECT doc_id, regexp_split_to_array(
            rtrim(lower(text), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '\s') AS words
        FROM documents WHERE text = '' OR regexp_matches(text, '\S')),
    term_counts AS (
        SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(words) AS term FROM token_docs) GROUP BY doc_id, term),
    vocabulary AS (
        SELECT term, (row_number() OVER (ORDER BY sum(tf) DESC, term) - 1)::INT AS index, sum(tf)::BIGINT AS occurrences, count(*) AS rows
        FROM term_counts GROUP BY term HAVING count(*) >= {min_rows} ORDER BY index LIMIT {size})"""


def _vectors(size: int, entry: str, columns: str) -> str:
    return f"""WITH {_vocabulary(size)},
        entries AS (SELECT doc_id, count(*)::INT AS n, string_agg({entry}, ',' ORDER BY index) AS listed
                    FROM term_counts JOIN vocabulary USING (term) GROUP BY doc_id)
        SELECT doc_id, {columns} FROM token_docs LEFT JOIN entries USING (doc_id)"""


SPACED = (r"\\[tnr]|[\t\n\r]", " ")


def _ingested(documents: str, conversations: str, benchmark: str) -> str:
    cells = ", ".join(f"nullif({_replaced(c, SPACED)}, '-') AS {c}" for c in ("nature", "source", "content"))
    return f"""
        WITH rows AS (
            SELECT doc_id AS id, {documents} AS kind, lang AS nature, source, text AS content FROM documents
            UNION ALL SELECT conv_id, {conversations}, role, NULL, text FROM conversations
            UNION ALL SELECT item_id, {benchmark}, NULL, NULL, text FROM benchmark)
        SELECT id, kind, {cells} FROM rows WHERE content IS NOT NULL AND id IS NOT NULL"""


SQL: dict[str, str] = {
    "ingest_union": _ingested("'documents'", "'conversations'", "'benchmark'"),
    "ingest_manifest": _ingested("'long'", "'short'", "'short'"),
    "clean_whitespace": rf"""SELECT doc_id, {_replaced("text", SPACED)} AS cleaned FROM documents""",
    "clean_text_a": f"SELECT doc_id, {CLEAN_A} AS cleaned FROM documents",
    "clean_text_a_wide": f"SELECT doc_id, {CLEAN_WIDE} AS cleaned FROM documents",
    "clean_text_b": f"SELECT doc_id, {CLEAN_B} AS cleaned FROM documents",
    "date_notation": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS order_day FROM orders",
    "date_notation_report": """
        WITH cells AS (
            SELECT CASE substr(o_orderpriority, 1, 1)
                       WHEN '1' THEN '-' WHEN '2' THEN '/' WHEN '3' THEN '-' WHEN '4' THEN ' ' ELSE '.' END AS separator,
                   CASE WHEN substr(o_orderpriority, 1, 1) = '1' THEN 'year_first'
                        WHEN substr(o_orderpriority, 1, 1) = '4' THEN 'named'
                        WHEN day(o_orderdate) = month(o_orderdate) THEN 'same'
                        WHEN day(o_orderdate) <= 12 THEN 'either'
                        WHEN substr(o_orderpriority, 1, 1) = '3' THEN 'month_first'
                        ELSE 'day_first' END AS kind
            FROM orders),
        counted AS (
            SELECT separator, count(*) AS cells, count_if(kind = 'year_first')::BIGINT AS year_first,
                   count_if(kind = 'named')::BIGINT AS named, count_if(kind = 'day_first')::BIGINT AS day_first,
                   count_if(kind = 'month_first')::BIGINT AS month_first, count_if(kind = 'same')::BIGINT AS same,
                   count_if(kind = 'either')::BIGINT AS either, 0::BIGINT AS unread
            FROM cells GROUP BY separator)
        SELECT *, CASE WHEN day_first > 0 AND month_first > 0 THEN 'mixed' WHEN day_first > 0 THEN 'day'
                       WHEN month_first > 0 THEN 'month' END AS comes_first,
               CASE WHEN (day_first > 0) = (month_first > 0) THEN either ELSE 0 END AS open
        FROM counted""",
    "date_standardize": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS order_day FROM orders",
    "recode_case": """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 10 ELSE 11 END AS term
        FROM orders WHERE o_orderstatus IN ('F', 'O')""",
    "group_normalize": f"""SELECT p_partkey,
        {_label("' ' || p_brand || ' - ' || p_type || '-  وال' || p_name || '-'")} AS label FROM part WHERE p_type <> 'PROMO'""",
    "distinct_keys": "SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders",
    "member_names": f"""SELECT c_custkey, {_replaced("name", *MEMBER_RULES)} AS member FROM (
        SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN c_name || ' بلافريج عمر' WHEN 1 THEN 'فيقة لشرف' ELSE c_name END AS name
        FROM customer)""",
    "explode_multi": """SELECT doc_id, part, count(*) AS n FROM (
        SELECT doc_id, trim(unnest(regexp_split_to_array(text, '[,،]'))) AS part FROM documents) GROUP BY doc_id, part""",
    "name_key": f"SELECT conv_id, turn, {_key('text', [*ARABIC_RULES, *LATIN_RULES])} AS name_key FROM conversations",
    "tokenize_regex": f"""SELECT conv_id, turn, len(words) AS n_tokens, array_to_string(words, ' ') AS tokens
        FROM (SELECT conv_id, turn, {_words("text")} AS words FROM conversations)""",
    "tokenize_whitespace": r"""SELECT conv_id, turn, len(words) AS n_tokens, array_to_string(words, '|') AS tokens FROM (
        SELECT conv_id, turn, regexp_split_to_array(
            rtrim(lower(text), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '\s') AS words
        FROM conversations WHERE text = '' OR regexp_matches(text, '\S'))""",
    "profile_summary": " UNION ALL ".join(
        [_profile_row(n) for n in ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")]
        + [_profile_row("l_returnflag", numeric=False)]),
    "roundtrip_parquet": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders",
    "surrogate_key": "SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS order_id, o_orderkey FROM orders",
    "reply_lag": """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
        CASE WHEN l_shipdate >= o_orderdate THEN 1 ELSE 0 END AS is_replied,
        CASE WHEN l_shipdate >= o_orderdate THEN date_diff('day', o_orderdate::DATE, l_shipdate::DATE) END AS days_to_reply
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "dim_member": f"""WITH {QUESTIONS} SELECT deputy_id, depute AS deputy_name, team_id AS deputy_team_id,
        party_id AS deputy_party_id, legislation_id FROM member""",
    "dim_team": f"WITH {QUESTIONS} SELECT team_id AS deputy_team_id, groupe AS deputy_team_name FROM team",
    "dim_party": f"WITH {QUESTIONS} SELECT party_id AS deputy_party_id, party AS deputy_party_code FROM party",
    "dim_ministry": f"WITH {QUESTIONS} SELECT ministry_id, ministry AS ministry_name FROM ministry",
    "dim_ministry_known": f"""WITH {QUESTIONS} SELECT row_number() OVER (ORDER BY ministry) AS ministry_id, ministry AS ministry_name
        FROM (SELECT DISTINCT ministry FROM classified WHERE ministry IS NOT NULL)""",
    "dim_session": """SELECT row_number() OVER (ORDER BY session_label) AS session_id, session_label
        FROM (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS session_label FROM orders)""",
    "fact_build": f"""WITH {QUESTIONS}
        SELECT question_id, numero AS question_number, n.legislation_id, session_id, question_nature, question_type,
               deputy_id, team_id AS deputy_team_id, party_id AS deputy_party_id, ministry_id,
               strftime(asked, '%Y-%m-%d') AS question_ask_date, question_nature AS question_subject,
               segment AS question_content, lower(segment) AS question_sector,
               CASE WHEN replied IS NOT NULL THEN 1 ELSE 0 END AS question_is_replied,
               strftime(replied, '%Y-%m-%d') AS question_reply_date,
               date_diff('day', asked::DATE, replied::DATE) AS question_days_to_reply
        FROM {FACT_SOURCE} JOIN member m
             ON n.depute = m.depute AND n.groupe = m.groupe AND n.legislation_id = m.legislation_id""",
    "fact_by_name": f"""WITH {QUESTIONS}
        SELECT session_id, ministry_id, count(*) AS facts, count(party_id) AS with_party
        FROM {FACT_SOURCE} JOIN member m ON n.depute = m.depute GROUP BY session_id, ministry_id""",
    "fact_star": f"""WITH {QUESTIONS}
        SELECT numero AS question_number, depute AS deputy_name, legislation_id AS member_term, groupe AS deputy_team_name,
               party AS deputy_party_code, ministry AS ministry_name, periode AS session_label FROM mentions""",
    "classify_vote": f"""WITH {_voting(IN_TEXTS, gated=False)}
        SELECT d.doc_id, coalesce(label, 'none') AS label FROM documents d LEFT JOIN best ON d.doc_id = best.doc_id""",
    "classify_vote_fallback": f"""WITH {_voting(IN_TEXTS, gated=True)},
        fixed_words AS (SELECT * FROM {_dictionary(c.FIXED_TOPICS)}),
        fixed_votes AS (SELECT doc_id, ord, label, count(*) AS n FROM documents, fixed_words WHERE contains(source, kw) GROUP BY ALL),
        fixed_best AS (SELECT doc_id, label FROM fixed_votes QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, ord) = 1)
        SELECT d.doc_id, coalesce(best.label, fixed_best.label, 'none') AS label FROM documents d
        LEFT JOIN best ON d.doc_id = best.doc_id LEFT JOIN fixed_best ON d.doc_id = fixed_best.doc_id""",
    "classify_first": f"""WITH hosts AS (SELECT * FROM {_scoped(c.HOSTS)}),
        scoped AS (SELECT page_id, url, regexp_extract(url, '/(en|fr|de|es)/', 1) AS scope,
                          regexp_extract(url, '^(https?://)', 1) AS start FROM pages)
        SELECT p.page_id, a.label AS first_label, b.label AS longest_label, e.label AS exact_label FROM pages p
        LEFT JOIN {_first_label("url", "contains({text}, kw)", "ord")} a ON p.page_id = a.page_id
        LEFT JOIN {_first_label("url", "contains({text}, kw)", "(-len(kw), ord)")} b ON p.page_id = b.page_id
        LEFT JOIN {_first_label("start", "{text} = kw", "ord")} e ON p.page_id = e.page_id""",
    "unique_mapping": """SELECT grp, min(label) AS label FROM (SELECT p_brand || '-' || p_size AS grp, p_type AS label FROM part)
        GROUP BY grp HAVING count(DISTINCT label) = 1""",
    "fuzzy_match": """SELECT DISTINCT a.p_brand, a.p_name AS name, b.p_name AS other_key, levenshtein(a.p_name, b.p_name) AS edits
        FROM part a JOIN part b ON a.p_brand = b.p_brand WHERE levenshtein(a.p_name, b.p_name) <= 1""",
    "party_resolve": RESOLVE,
    "word_count": _word_count("documents"),
    "word_topk": f"{_word_count('documents')} ORDER BY n DESC, word LIMIT 200",
    "word_count_subject": _word_count("benchmark"),
    "ngram_count": NGRAMS,
    "ngram_topk": f"{NGRAMS} ORDER BY n DESC, ngram LIMIT 100",
    "tfidf_top": f"{TERMS} SELECT term, round(total * idf, 4) AS score FROM idf",
    "tfidf_terms": f"{TERMS} SELECT doc_id, tf.term, tf.tf, round(tf.tf * idf, 4) AS score FROM tf JOIN idf ON tf.term = idf.term",
    "tfidf_hashed": f"{BUCKETS} SELECT term_index, round(total * idf, 4) AS score FROM idf",
    "tfidf_hashed_terms": f"""{BUCKETS} SELECT doc_id, tf.term_index, tf.tf, round(tf.tf * idf, 4) AS score
        FROM tf JOIN idf ON tf.term_index = idf.term_index""",
    "vocabulary_fit": f"WITH {_vocabulary(1 << 18)} SELECT * FROM vocabulary",
    "vocabulary_cut": f"WITH {_vocabulary(c.VOCABULARY, 2)} SELECT * FROM vocabulary",
    "binary_vectors": _vectors(1 << 18, "index", "coalesce(n, 0) AS n_terms, coalesce(listed, '') AS indices"),
    "count_vectors_cut": _vectors(c.VOCABULARY, "index || ':' || tf", "coalesce(listed, '') AS entries"),
    "minhash_signatures": f"WITH {WORD_SETS} SELECT doc_id, {_signature(5)} FROM docs",
    "neardup_exact": f"""WITH {SETS}, {_pairs("docs", "doc_id")},
        member AS (SELECT doc_id, set_id, copies FROM docs JOIN sets ON docs.w = sets.w)
        SELECT ma.set_id AS set_a, mb.set_id AS set_b, ma.copies AS copies_a, mb.copies AS copies_b,
               a AS doc_a, b AS doc_b, round(distance, 6) AS distance
        FROM pairs JOIN member ma ON a = ma.doc_id JOIN member mb ON b = mb.doc_id
        WHERE ma.set_id < mb.set_id OR (ma.set_id = mb.set_id AND a < b)""",
    "neardup_minhash": _minhash_pairs(5, c.HASH_ROWS),
    "neardup_banded": _minhash_pairs(c.BANDS, c.BAND_ROWS),
    "neardup_between": rf"""WITH {SETS},
        cut AS (SELECT doc_id, regexp_replace(text, '^[^\n]*\n', '') AS text FROM documents),
        cut_docs AS (
            SELECT doc_id, list_sort(list_distinct(regexp_split_to_array(
                rtrim(lower(text), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '\s'))) AS w
            FROM cut WHERE text = '' OR regexp_matches(text, '\S')),
        cut_sets AS (SELECT min(doc_id) AS set_id, count(*) AS copies, w FROM cut_docs GROUP BY w),
        x AS (SELECT set_id, copies, len(w) AS n, unnest(w) AS word FROM cut_sets),
        y AS (SELECT set_id, copies, len(w) AS n, unnest(w) AS word FROM sets),
        met AS (
            SELECT x.set_id AS set_a, y.set_id AS set_b, any_value(x.copies) AS copies_a, any_value(y.copies) AS copies_b,
                   1.0::DOUBLE - count(*)::DOUBLE / (any_value(x.n) + any_value(y.n) - count(*)) AS distance
            FROM x JOIN y ON x.word = y.word GROUP BY x.set_id, y.set_id)
        SELECT set_a, set_b, copies_a, copies_b, round(distance, 6) AS distance FROM met WHERE distance < 0.2::DOUBLE""",
    "neardup_rows": f"""WITH {SETS}, {_pairs("sets", "set_id")},
        near AS (
            SELECT a AS set_id, b AS near_set_id, distance FROM pairs
            UNION ALL SELECT set_id, set_id, 0.0::DOUBLE FROM sets WHERE copies > 1),
        member AS (SELECT doc_id, set_id FROM docs JOIN sets ON docs.w = sets.w)
        SELECT d.doc_id, d.lang, d.source, near_set_id, sets.copies, round(distance, 6) AS distance
        FROM near JOIN member ON near.set_id = member.set_id JOIN sets ON near_set_id = sets.set_id
             JOIN documents d ON d.doc_id = member.doc_id""",
    "dup_groups": f"""{DUPLICATES}, all_sets AS (SELECT min(doc_id) AS set_id, w FROM docs GROUP BY w)
        SELECT found.doc_id, set_id, n AS duplicate_count
        FROM found JOIN docs ON found.doc_id = docs.doc_id JOIN all_sets ON docs.w = all_sets.w""",
    "dup_list": f"""WITH {WORD_SETS}, {_pairs("docs", "doc_id")}
        SELECT a AS doc_id, b AS duplicate_id, round(distance, 6) AS distance FROM pairs WHERE a IN (SELECT doc_id FROM labels)""",
    "dup_flags": f"""{DUPLICATES} SELECT d.doc_id, d.lang, d.source, coalesce(n, 0) AS duplicate_count,
        CASE WHEN n IS NULL THEN 0 ELSE 1 END AS is_duplicate FROM documents d LEFT JOIN found ON d.doc_id = found.doc_id""",
}
