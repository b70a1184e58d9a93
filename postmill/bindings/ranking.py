"""Feedback, kNN and recommendation queries over documents, labels and embeddings."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions.text import haystack, norm_company, primary_seniority, word_mentioned
from ..functions.values import days_before
from ..functions.verdict import parse_verdict
from ..operators import feedback as fb
from ..operators import filters as fl
from ..operators.metrics import outcome_counts
from ..operators.tracking import join_posting_application
from ..operators.knn import knn_topk, knn_topk_many
from ..plans.recommend import (
    Request, join_hits_application, join_hits_posting, pin_hits, recommend, rerank_with_scores,
    resort_stable, shortlist,
)
from .registry import query
from .tables import (
    APPLICATION_SQL, AS_OF, INDEX_SQL, LEVELS, POSTING_SQL, PROFILE_VECTOR_SQL, SKILLS, application,
    hay_sql, index, mentioned_sql, ntz, posting, profile_vector, table, words_in_sql,
)

NEG = "status IN ('dismissed', 'rejected')"
BASE = f"WITH {POSTING_SQL}, {APPLICATION_SQL}"
TRACKED = f"""tracked AS (
  SELECT p.*, {NEG.replace('status', 'a.status')} AS negative
  FROM posting p JOIN application a ON a.vacancy_id = p.id),
base AS (SELECT avg(CAST(CAST(negative AS INTEGER) AS DOUBLE)) AS b FROM tracked)"""
SIGNAL = """CASE WHEN total < 3 THEN NULL
       WHEN CAST(negatives AS DOUBLE) / total - b >= CAST(0.3 AS DOUBLE) THEN -10
       WHEN b - CAST(negatives AS DOUBLE) / total >= CAST(0.3 AS DOUBLE) THEN 10 END"""


def feedback_sql(members: str, silent: bool = False, head: str = f"{BASE}, {TRACKED}") -> str:
    return f"""{head}, members AS ({members}),
counted AS (SELECT category, count(*) AS total, count(*) FILTER (WHERE negative) AS negatives
            FROM members GROUP BY category)
SELECT category, total, negatives, CAST({SIGNAL} AS INTEGER) AS delta FROM counted, base
{'' if silent else 'WHERE ' + SIGNAL + ' IS NOT NULL'}"""


SKILL_MEMBERS = f"""SELECT unnest({words_in_sql('hay', SKILLS)}) AS category, negative
  FROM (SELECT {hay_sql()} AS hay, negative FROM tracked) t"""


def primary_sql(title: str, levels=LEVELS) -> str:
    """The earliest plain position among whole-word matches, ties alphabetical."""
    cases = ", ".join(
        f"CASE WHEN {mentioned_sql(title, chr(39) + lv + chr(39))} "
        f"THEN {{'pos': position('{lv}' IN {title}), 'level': '{lv}'}} END" for lv in levels)
    return f"(list_min(list_filter([{cases}], lambda x: x IS NOT NULL)).level)"


LEVEL_MEMBERS = f"""SELECT level AS category, negative FROM (
    SELECT {primary_sql('lower(title)')} AS level, negative FROM tracked) WHERE level IS NOT NULL"""


@query("baseline_ratio", f"{BASE}, {TRACKED} SELECT b AS baseline FROM base")
def _baseline(spark, d):
    return fb.baseline_ratio(posting(spark, d), application(spark, d))


@query("skill_feedback", feedback_sql(SKILL_MEMBERS))
def _skill_feedback(spark, d):
    return fb.skill_feedback(posting(spark, d), application(spark, d), SKILLS)


@query("remote_feedback", feedback_sql(
    "SELECT 'remote' AS category, negative FROM tracked WHERE remote", silent=True))
def _remote_feedback(spark, d):
    tracked = fb.tracked_rows(
        posting(spark, d), application(spark, d), categories=fb.remote_categories())
    return fb.category_feedback(tracked, F.col("categories"), keep_silent=True)


@query("seniority_feedback", feedback_sql(LEVEL_MEMBERS, silent=True))
def _seniority_feedback(spark, d):
    tracked = fb.tracked_rows(
        fb.searchable(posting(spark, d)), application(spark, d),
        categories=fb.seniority_categories(LEVELS))
    return fb.category_feedback(tracked, F.col("categories"), keep_silent=True)


@query("category_feedback", feedback_sql(
    "SELECT unnest(regexp_extract_all(lower(title), '[\\p{L}\\p{N}]+')) AS category, negative "
    "FROM tracked"))
def _category_feedback(spark, d):
    """The generic form: here every word of the title is a category."""
    words = F.regexp_extract_all(F.lower("title"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    tracked = fb.tracked_rows(posting(spark, d), application(spark, d), categories=words)
    return fb.category_feedback(tracked, F.col("categories"))


EXCLUDED = f"""excluded AS (
  SELECT lower(trim(company)) AS company_key, count(*) AS n FROM tracked
  WHERE trim(company) <> '' GROUP BY 1 HAVING bool_and(negative))"""


@query("excluded_companies", f"{BASE}, {TRACKED}, {EXCLUDED} SELECT * FROM excluded")
def _excluded(spark, d):
    return fb.excluded_companies(posting(spark, d), application(spark, d))


@query("subset_test", """
SELECT o_custkey, bool_and(o_orderstatus IN ('F', 'P')) AS all_closed
FROM orders GROUP BY o_custkey""")
def _subset_test(spark, d):
    """Statuses of a customer's orders ⊆ {F, P}."""
    return table(spark, d, "orders").groupBy("o_custkey").agg(
        F.bool_and(F.col("o_orderstatus").isin("F", "P")).alias("all_closed"))


@query("company_keys", f"""{BASE}
SELECT lower(trim(company)) AS company_key, count(*) AS n FROM posting GROUP BY 1""")
def _company_keys(spark, d):
    return posting(spark, d).groupBy(norm_company(F.col("company")).alias("company_key")).agg(
        F.count(F.lit(1)).alias("n"))


@query("norm_company", """
SELECT c_custkey, replace(lower(regexp_replace(company, '\\A[\\s\\x{00A0}]+|[\\s\\x{00A0}]+\\z', '', 'g')), 'ß', 'ss')
         AS company_key
FROM (SELECT c_custkey, chr(160) || chr(9) || c_name || ' ' || c_mktsegment || ' GROßHANDEL ' || chr(160) AS company
      FROM customer)""")
def _norm_company(spark, d):
    nbsp = F.lit(" ")
    raw = F.concat(nbsp, F.lit("\t"), F.col("c_name"), F.lit(" "), F.col("c_mktsegment"),
                   F.lit(" GROßHANDEL "), nbsp)
    return table(spark, d, "customer").select("c_custkey", norm_company(raw).alias("company_key"))


# --- kNN and ranking -----------------------------------------------------------

DOT = "list_inner_product"
RAW = (f"(1.0 + {DOT}(embedding, q) / (sqrt({DOT}(embedding, embedding)) * sqrt({DOT}(q, q)))) / 2")


def hits_sql(k: int, where: str = "") -> str:
    return f"""hits AS (
  SELECT vacancy_id, source, {RAW} AS raw FROM idx, query {where}
  ORDER BY raw DESC, vacancy_id LIMIT {k})"""


KNN = f"{BASE}, {INDEX_SQL}, {PROFILE_VECTOR_SQL}"


def _raw6(df):
    return df.withColumn("raw", F.round("raw", 6))


@query("knn_topk", f"""{KNN}, {hits_sql(20)}
SELECT vacancy_id, source, round(raw, 6) AS raw FROM hits""")
def _knn(spark, d):
    """The hits alone, orphans included; ``join_hits_posting`` adds the posting's columns."""
    hits = knn_topk(index(spark, d), profile_vector(spark, d), 20)
    return _raw6(hits.select("vacancy_id", "source", "raw"))


@query("knn_topk_sources", f"""{KNN}, {hits_sql(20, "WHERE source IN ('src1', 'src2', 'src3')")}
SELECT vacancy_id, source, round(raw, 6) AS raw FROM hits""")
def _knn_sources(spark, d):
    hits = knn_topk(index(spark, d), profile_vector(spark, d), 20, ["src1", "src2", "src3"])
    return _raw6(hits.select("vacancy_id", "source", "raw"))


@query("knn_topk_many", f"""WITH {POSTING_SQL}, {INDEX_SQL},
query AS (SELECT vec_id AS profile_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings
          WHERE label = 3),
ranked AS (SELECT profile_id, vacancy_id, {RAW} AS raw FROM idx, query)
SELECT profile_id, vacancy_id, round(raw, 6) AS raw,
       row_number() OVER (PARTITION BY profile_id ORDER BY raw DESC, vacancy_id) AS rank
FROM ranked QUALIFY rank <= 10""")
def _knn_many(spark, d):
    """The vectors of one label are the profiles: their number grows with the table."""
    profiles = table(spark, d, "embeddings").filter("label = 3").select(
        F.col("vec_id").alias("profile_id"), "embedding")
    hits = knn_topk_many(index(spark, d), profiles, 10, len(profile_vector(spark, d)))
    return _raw6(hits.select("profile_id", "vacancy_id", "raw", F.col("rank").cast("bigint")))


def _hits(spark, d, k=50):
    return pin_hits(
        knn_topk(index(spark, d), profile_vector(spark, d), k).select("vacancy_id", "raw"))


@query("join_hits_posting", f"""{KNN}, {hits_sql(50)}
SELECT h.vacancy_id, p.source, p.company, p.location, round(h.raw, 6) AS raw
FROM hits h JOIN posting p ON p.id = h.vacancy_id""")
def _join_hits_posting(spark, d):
    rows = join_hits_posting(_hits(spark, d), posting(spark, d))
    return _raw6(rows.select("vacancy_id", "source", "company", "location", "raw"))


@query("join_hits_application", f"""{KNN}, {hits_sql(50)}
SELECT h.vacancy_id, a.status AS application_status
FROM hits h LEFT JOIN application a USING (vacancy_id)""")
def _join_hits_application(spark, d):
    return join_hits_application(_hits(spark, d), application(spark, d)).select(
        "vacancy_id", "application_status")


FEEDBACK_ALL = f"""members AS (
  SELECT 'skill' AS dim, category, negative FROM ({SKILL_MEMBERS})
  UNION ALL SELECT 'remote', 'remote', negative FROM tracked WHERE remote
  UNION ALL SELECT 'seniority', category, negative FROM ({LEVEL_MEMBERS})),
counted AS (SELECT dim, category, count(*) AS total, count(*) FILTER (WHERE negative) AS negatives
            FROM members GROUP BY dim, category),
feedback AS (SELECT dim, category, total, negatives, {SIGNAL} AS delta FROM counted, base
             WHERE {SIGNAL} IS NOT NULL)"""


def recommend_sql(k: int, min_score: int) -> str:
    return f"""{KNN}, {TRACKED}, {EXCLUDED}, {hits_sql(k)}, {FEEDBACK_ALL},
candidates AS (
  SELECT p.*, h.raw, a.status AS application_status, {words_in_sql(hay_sql(' '), SKILLS)} AS words,
         {primary_sql('lower(p.title)')} AS level
  FROM (SELECT vacancy_id, raw FROM hits) h JOIN posting p ON p.id = h.vacancy_id
  LEFT JOIN application a ON a.vacancy_id = p.id
  WHERE p.last_seen_at >= TIMESTAMP '{AS_OF}' - INTERVAL 5 DAY
    AND coalesce(a.status NOT IN ('dismissed', 'rejected'), true)
    AND lower(trim(p.company)) NOT IN (SELECT company_key FROM excluded)),
adjusted AS (
  SELECT c.*, CAST(greatest(-20, least(20, coalesce((
      SELECT sum(f.delta) FROM feedback f
      WHERE (f.dim = 'skill' AND list_contains(c.words, f.category))
         OR (f.dim = 'remote' AND c.remote)
         OR (f.dim = 'seniority' AND f.category = c.level)), 0))) AS INTEGER) AS adjustment
  FROM candidates c),
scored AS (
  SELECT *, greatest(0, least(100, CAST(round_even(raw * 100, 0) AS INTEGER) + adjustment)) AS score
  FROM adjusted)
SELECT id AS vacancy_id, source, company, url, round(raw, 6) AS raw, adjustment, score,
       application_status
FROM scored WHERE score >= {min_score}"""


def _recommend(spark, d, k=100, min_score=40):
    return recommend(
        posting(spark, d), application(spark, d), index(spark, d), profile_vector(spark, d),
        SKILLS, Request(as_of=ntz(AS_OF), top_k=k, min_score=min_score), levels=LEVELS)


@query("recommend", recommend_sql(100, 40))
def recommend_query(spark, d):
    return _raw6(_recommend(spark, d)).drop("title")


@query("filter_min_score", recommend_sql(100, 60))
def _filter_min_score(spark, d):
    """The score floor works on adjusted scores."""
    return _raw6(_recommend(spark, d, min_score=60)).drop("title")


@query("resort_stable", f"""
SELECT vacancy_id, score, row_number() OVER (ORDER BY score DESC, raw DESC, vacancy_id) AS position
FROM ({recommend_sql(100, 0)}) ORDER BY position LIMIT 10""")
def _resort(spark, d):
    """The order itself, made visible as a position."""
    return shortlist(resort_stable(_recommend(spark, d, min_score=0)), 10).select(
        "vacancy_id", "score", F.col("position").cast("bigint"))


@query("shortlist", f"""SELECT vacancy_id, company, score FROM ({recommend_sql(100, 0)})
ORDER BY score DESC, raw DESC, vacancy_id LIMIT 5""")
def _shortlist(spark, d):
    return shortlist(_recommend(spark, d, min_score=0), 5).select("vacancy_id", "company", "score")


# Responses in every shape a scorer can come back with.
RESPONSE_KINDS = 7


def responses(rows, n, reasoning):
    """``rows`` with one response each, its shape picked by the number ``n``."""
    kind = n % RESPONSE_KINDS
    text = F.coalesce(reasoning, F.lit(""))
    body = F.to_json(F.struct(
        (n % 101).alias("score"), text.alias("reasoning"),
        F.array(F.lit("a"), F.lit("b")).alias("concerns")))

    def envelope(failed: bool, result):
        return F.to_json(F.struct(F.lit(failed).alias("is_error"), result.alias("result")))

    return rows.select(
        *rows.columns,
        F.when(kind == 1, F.lit(2)).otherwise(F.lit(0)).alias("returncode"),
        (kind == 0).alias("timed_out"),
        F.when(kind == 2, F.concat(F.lit("oops "), text))
        .when(kind == 3, envelope(True, F.lit("overloaded")))
        .when(kind == 4, envelope(False, F.lit("no json here")))
        .when(kind == 5, envelope(False, F.concat(F.lit("```json\n"), body, F.lit("\n```"))))
        .otherwise(envelope(False, body)).alias("stdout"),
    )


def turn_responses(spark, d):
    """One response per conversation turn, its reasoning the turn's text."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "text")
    n = F.coalesce(F.length("text"), F.lit(0)) + F.col("turn")
    return responses(turns, n, F.col("text")).select(
        "conv_id", "turn", "returncode", "timed_out", "stdout")


def outcome_sql(n: str) -> str:
    return f"""CASE ({n}) % 7 WHEN 0 THEN 'timeout' WHEN 1 THEN 'nonzero_exit'
  WHEN 2 THEN 'bad_stdout' WHEN 3 THEN 'api_error' WHEN 4 THEN 'parse_error' ELSE 'success' END"""


TURN = "coalesce(length(text), 0) + turn"
TURN_OUTCOME = outcome_sql(TURN)


@query("parse_verdict", f"""
SELECT conv_id, turn, {TURN_OUTCOME} AS outcome,
       CASE WHEN {TURN_OUTCOME} = 'success' THEN CAST(({TURN}) % 101 AS INTEGER) END AS score,
       CASE WHEN {TURN_OUTCOME} = 'success' THEN md5(coalesce(text, '')) END AS reasoning_md5,
       CASE WHEN {TURN_OUTCOME} = 'success' THEN 2 END AS n_concerns
FROM conversations""")
def _parse_verdict(spark, d):
    v = parse_verdict(F.col("returncode"), F.col("timed_out"), F.col("stdout"))
    return turn_responses(spark, d).select("conv_id", "turn", v.alias("v")).select(
        "conv_id", "turn", "v.outcome", "v.score", F.md5("v.reasoning").alias("reasoning_md5"),
        F.when(F.col("v.concerns").isNotNull(), F.size("v.concerns")).alias("n_concerns"))


@query("verdict_outcomes", """
SELECT CASE WHEN role = 'assistant' THEN 'score_vacancy' ELSE role END AS operation,
       'bad_stdout' AS outcome, count(*) AS n
FROM conversations GROUP BY ALL""")
def _verdict_outcomes(spark, d):
    """Plain conversation turns are no JSON, so every one is bad output."""
    v = parse_verdict(F.lit(0), F.lit(False), F.col("text"))
    operation = F.when(F.col("role") == "assistant", F.lit("score_vacancy")).otherwise(F.col("role"))
    return table(spark, d, "conversations").select(
        operation.alias("operation"), v["outcome"].alias("outcome")
    ).groupBy("operation", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("outcome_counts", f"""SELECT 'score_vacancy' AS operation, {TURN_OUTCOME} AS outcome, count(*) AS n
FROM conversations GROUP BY ALL""")
def _outcome_counts(spark, d):
    v = parse_verdict(F.col("returncode"), F.col("timed_out"), F.col("stdout"))
    return outcome_counts(
        turn_responses(spark, d).select(F.lit("score_vacancy").alias("operation"),
                                        v["outcome"].alias("outcome")), "operation", "outcome")


@query("rerank_with_scores", f"""
SELECT s.vacancy_id, CAST(d.n_chars % 101 AS INTEGER) AS score, s.position
FROM (SELECT vacancy_id, row_number() OVER (ORDER BY score DESC, raw DESC, vacancy_id) AS position
      FROM ({recommend_sql(100, 0)}) QUALIFY position <= 10) s
JOIN documents d ON d.doc_id = s.vacancy_id WHERE d.n_chars % 7 >= 5""")
def _rerank(spark, d):
    """Every posting got a response; those of the shortlist count."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vacancy_id"), "n_chars", "text")
    scored = responses(docs, F.col("n_chars"), F.substring_index("text", "\n", 1)).drop(
        "n_chars", "text")
    short = shortlist(_recommend(spark, d, min_score=0), 10)
    return rerank_with_scores(short, scored).select(
        "vacancy_id", "score", F.col("position").cast("bigint"))


# --- filters over postings -------------------------------------------------------

@query("filter_keywords", f"""{BASE}
SELECT id, source FROM posting WHERE contains({hay_sql()}, 'trash') OR contains({hay_sql()}, 'und die')""")
def _filter_keywords(spark, d):
    return fl.filter_keywords(posting(spark, d), ["Trash", "und die"]).select("id", "source")


@query("filter_sources", f"{BASE} SELECT id, company FROM posting WHERE source IN ('src1', 'src7')")
def _filter_sources(spark, d):
    return fl.filter_sources(posting(spark, d), ["src1", "src7"]).select("id", "company")


@query("filter_fresh", f"""{BASE} SELECT id, last_seen_at FROM posting
WHERE last_seen_at >= TIMESTAMP '{AS_OF}' - INTERVAL 5 DAY""")
def _filter_fresh(spark, d):
    return fl.filter_fresh(posting(spark, d), ntz(AS_OF)).select("id", "last_seen_at")


@query("filter_hidden", f"""{BASE} SELECT p.id, p.company FROM posting p
LEFT JOIN application a ON a.vacancy_id = p.id WHERE coalesce(NOT a.{NEG}, true)""")
def _filter_hidden(spark, d):
    return fl.filter_hidden(posting(spark, d), application(spark, d)).select("id", "company")


@query("anti_join_excluded", f"""{BASE}, {TRACKED}, {EXCLUDED}
SELECT id, company FROM posting WHERE lower(trim(company)) NOT IN (SELECT company_key FROM excluded)""")
def _anti_join_excluded(spark, d):
    p = posting(spark, d)
    return fl.filter_excluded_company(
        p, fb.excluded_companies(p, application(spark, d))).select("id", "company")


@query("filter_excluded_company", f"""{BASE}, {TRACKED}, {EXCLUDED}
SELECT company, count(*) AS n FROM posting
WHERE lower(trim(company)) NOT IN (SELECT company_key FROM excluded) GROUP BY 1""")
def _filter_excluded_company(spark, d):
    p = posting(spark, d)
    return fl.filter_excluded_company(p, fb.excluded_companies(p, application(spark, d))).groupBy(
        "company").agg(F.count(F.lit(1)).alias("n"))


@query("filter_applications", f"WITH {APPLICATION_SQL} SELECT id, status FROM application WHERE {NEG}")
def _filter_applications(spark, d):
    rows = application(spark, d).withColumn("updated_at", F.col("id"))
    return fl.filter_applications(rows, ["dismissed", "rejected"]).select("id", "status")


@query("join_posting_application", f"""{BASE}
SELECT p.id, p.company, a.status AS application_status
FROM posting p JOIN application a ON a.vacancy_id = p.id""")
def _join_posting_application(spark, d):
    return join_posting_application(posting(spark, d), application(spark, d)).select(
        "id", "company", "application_status")


THETA = ("trash", "idiot", "der", "of the", "la")


@query("theta_join_skill_text", f"""{BASE}
SELECT id, unnest({words_in_sql('hay', THETA)}) AS word
FROM (SELECT id, {hay_sql()} AS hay FROM posting)""")
def _theta(spark, d):
    return fb.theta_join_words(posting(spark, d), THETA)


PHRASE = r"^[\p{L}\p{N}]+ [\p{L}\p{N}]+"
ODD_WORDS = ("c++", "c#", "|", "###", "the,")
# A phrase of plain words, between ends that are a blank or any other mark.
PHRASE_TEST = " OR ".join(
    f"contains(marked, '{before}' || word || '{after}')" for before in "# " for after in "# ")
ODD_TESTS = "\n  UNION ALL ".join(
    "SELECT id, '{}' AS word FROM hays WHERE regexp_matches(hay, "
    "'(?:\\A|[^\\p{{L}}\\p{{N}}]){}(?:\\z|[^\\p{{L}}\\p{{N}}])')".format(
        w, re.sub(r"([^\w\s])", r"\\\1", w)) for w in ODD_WORDS)


@query("theta_join_single_words", f"""{BASE},
single AS (
  SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+'))) AS word FROM benchmark),
phrase AS (SELECT DISTINCT lower(regexp_extract(text, '{PHRASE}')) AS word FROM benchmark),
hays AS (SELECT id, hay, regexp_replace('#' || hay || '#', '[^\\p{{L}}\\p{{N}} ]', '#', 'g') AS marked
         FROM (SELECT id, {hay_sql()} AS hay FROM posting)),
tokens AS (SELECT DISTINCT id, unnest(regexp_extract_all(hay, '[\\p{{L}}\\p{{N}}]+')) AS word FROM hays),
found AS (
  SELECT id, word FROM tokens JOIN single USING (word)
  UNION ALL SELECT id, word FROM phrase JOIN hays ON word <> '' AND ({PHRASE_TEST})
  UNION ALL {ODD_TESTS})
SELECT word, count(*) AS n FROM found GROUP BY word""")
def _theta_table(spark, d):
    """Words and opening phrases of the benchmark texts, and words with other characters,
    against every posting, counted per word."""
    run = F.lit(r"[\p{L}\p{N}]+")
    text = table(spark, d, "benchmark")
    odd = F.array(*[F.lit(w) for w in ODD_WORDS])
    words = text.select(F.explode(F.concat(
        F.regexp_extract_all("text", run, F.lit(0)),
        F.array(F.regexp_extract("text", PHRASE, 0)), odd)).alias("word"))
    return fb.theta_join_single_words(posting(spark, d), words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n"))


@query("word_mentioned", f"""{BASE}
SELECT location, count(*) FILTER (WHERE {mentioned_sql(hay_sql(), "'la'")}) AS whole_word,
       count(*) FILTER (WHERE contains({hay_sql()}, 'la')) AS substring
FROM posting GROUP BY location""")
def _word_mentioned(spark, d):
    rows = posting(spark, d).select(
        "location", haystack(F.col("title"), F.col("description"), F.col("tags"), ",").alias("hay"))
    return rows.groupBy("location").agg(
        F.count_if(word_mentioned(F.col("hay"), "la")).alias("whole_word"),
        F.count_if(F.contains("hay", F.lit("la"))).alias("substring"))


@query("join_feedback_delta", f"""{BASE}, {TRACKED}, {FEEDBACK_ALL}
SELECT p.id, CAST(coalesce(sum(f.delta), 0) AS INTEGER) AS delta
FROM (SELECT id, unnest({words_in_sql('hay', SKILLS)}) AS w
      FROM (SELECT id, {hay_sql()} AS hay FROM posting)) p
LEFT JOIN (SELECT * FROM feedback WHERE dim = 'skill') f ON f.category = w
GROUP BY p.id""")
def _join_feedback_delta(spark, d):
    p = posting(spark, d)
    matched = fb.theta_join_words(p, SKILLS).withColumnRenamed("word", "category")
    return fb.join_feedback_delta(matched, fb.skill_feedback(p, application(spark, d), SKILLS))


@query("score_adjustment", f"""{BASE}, {TRACKED}, {FEEDBACK_ALL},
p AS (SELECT id, remote, {words_in_sql(hay_sql(' '), SKILLS)} AS words,
             {primary_sql('lower(title)')} AS level FROM posting)
SELECT p.id, CAST(greatest(-20, least(20, coalesce(sum(f.delta), 0))) AS INTEGER) AS adjustment
FROM p LEFT JOIN feedback f
  ON (f.dim = 'skill' AND list_contains(p.words, f.category))
  OR (f.dim = 'remote' AND p.remote) OR (f.dim = 'seniority' AND f.category = p.level)
GROUP BY p.id""")
def _score_adjustment(spark, d):
    p = posting(spark, d)
    signals = fb.collect_signals(fb.all_feedback(p, application(spark, d), SKILLS, LEVELS))
    return fb.with_adjustment(p, signals, SKILLS, LEVELS).select("id", "adjustment")


@query("seniority_mix", f"""{BASE}
SELECT {primary_sql('lower(title)')} AS level, location, count(*) AS n FROM posting GROUP BY ALL""")
def _seniority_mix(spark, d):
    return posting(spark, d).groupBy(
        primary_seniority(F.lower("title"), LEVELS).alias("level"), "location"
    ).agg(F.count(F.lit(1)).alias("n"))


@query("primary_seniority", f"""{BASE}
SELECT id, {primary_sql('lower(title)')} AS level FROM posting""")
def _primary_seniority(spark, d):
    return posting(spark, d).select(
        "id", primary_seniority(F.lower("title"), LEVELS).alias("level"))


@query("age_cutoff", f"""SELECT event_type, count(*) AS n FROM events
WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 5 DAY GROUP BY 1""")
def _age_cutoff(spark, d):
    return table(spark, d, "events").filter(
        F.col("ts") >= days_before(ntz("2024-01-30 00:00:00"), 5)
    ).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
