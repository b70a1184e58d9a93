"""Scalar helpers as whole-table jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import (
    COUNTRY_CURRENCY, DAYS_PER_MONTH, HOURS_PER_DAY, PROMPT_DESCRIPTION_LIMIT, SCORING_PROMPT,
    WRITING_CONTEXT,
)
from ..functions import html as H
from ..functions import text as T
from ..functions import urls as U
from ..functions import values as V
from ..functions.packed_title import parse_packed_title, parse_salary_text
from ..functions.verdict import profile_query_text, scoring_prompt, writing_context
from ..operators.filters import filter_url_slug, posting_card
from ..operators.knn import cosine, cosine_score
from ..schemas import PROFILE_FILE
from ..operators.ordered import number_rows
from ..sources.feeds import from_payload
from ..sources.profile import first_profile, scan_profile
from .registry import query
from .tables import (
    POSTING_SQL, posting, profile_vector, row_count, table,
)


# --- HTML ------------------------------------------------------------------------

ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"),
            ("&nbsp;", " "))


def entities_sql(text: str) -> str:
    for name, value in ENTITIES:
        text = f"replace({text}, '{name}', '{value}')"
    return f"regexp_replace({text}, '&amp;?', '&', 'g')"


def html_sql(html: str) -> str:
    out = html
    for tag in ("script", "style"):
        out = f"regexp_replace({out}, '(?is)<{tag}[^>]*>.*?</{tag}\\s*>', '', 'g')"
    out = f"regexp_replace({out}, '(?s)<!--.*?-->', '', 'g')"
    for tag in ("template", "head"):
        out = f"regexp_replace({out}, '(?is)<{tag}(?:\\s[^>]*)?>.*?</{tag}\\s*>', '', 'g')"
    out = f"""regexp_replace({out},
        '(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|td|th)(?:[\\s/][^>]*)?>', ' ', 'g')"""
    out = f"regexp_replace({out}, '</?[a-zA-Z][^>]*>', '', 'g')"
    out = f"regexp_replace({out}, '<[!?][^>]*>', '', 'g')"
    return f"trim(regexp_replace({entities_sql(out)}, '[\\s\\x{{00A0}}]+', ' ', 'g'))"


@query("html_to_text", f"""SELECT page_id, md5(t) AS text_md5, length(t) AS n_chars
FROM (SELECT page_id, {html_sql('html')} AS t FROM pages)""")
def html_to_text_query(spark, d):
    text = H.html_to_text(F.col("html"), unescape_first=False)
    return table(spark, d, "pages").select("page_id", text.alias("t")).select(
        "page_id", F.md5("t").alias("text_md5"), F.length("t").cast("bigint").alias("n_chars"))


@query("unescape_entities", f"""SELECT page_id, md5({entities_sql(
    "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}) AS title_md5 FROM pages""")
def _unescape(spark, d):
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    return table(spark, d, "pages").select(
        "page_id", F.md5(H.unescape_entities(title)).alias("title_md5"))


HOST_SQL = "lower(regexp_extract(url, '://([^/?#]*)', 1))"


@query("page_text_stats", f"""SELECT {HOST_SQL} AS host, count(*) AS pages,
  CAST(sum(length(t)) AS BIGINT) AS text_chars, CAST(sum(length(html)) AS BIGINT) AS html_chars
FROM (SELECT url, html, {html_sql('html')} AS t FROM pages) GROUP BY 1""")
def _page_text_stats(spark, d):
    text = H.html_to_text(F.col("html"), unescape_first=False)
    return table(spark, d, "pages").groupBy(U.url_host(F.col("url")).alias("host")).agg(
        F.count(F.lit(1)).alias("pages"), F.sum(F.length(text)).alias("text_chars"),
        F.sum(F.length("html")).alias("html_chars"))


# --- URLs ------------------------------------------------------------------------

@query("url_parts", """SELECT page_id, split_part(url, '?', 1) AS bare,
  regexp_extract(regexp_replace(split_part(url, '?', 1), '/+\\z', ''), '[^/]*\\z') AS last_segment,
  nullif(regexp_extract(url, '/[a-z]{2}/(\\d+)', 1), '') AS number
FROM pages""")
def _url_parts(spark, d):
    bare = U.without_query(F.col("url"))
    return table(spark, d, "pages").select(
        "page_id", bare.alias("bare"), U.last_segment(bare).alias("last_segment"),
        U.id_in_url(F.col("url"), r"/[a-z]{2}/(\d+)").alias("number"))


@query("filter_url_host", """SELECT page_id, url FROM pages
WHERE url LIKE 'https://spam-farm.example.org/%' OR url = 'https://spam-farm.example.org'""")
def _filter_url_host(spark, d):
    return table(spark, d, "pages").filter(
        U.host_and_scheme_allowed(F.col("url"), "spam-farm.example.org")).select("page_id", "url")


@query("filter_url_slug", """SELECT page_id, url FROM pages
WHERE contains(lower(url), 'blog') OR contains(lower(url), '/de/')""")
def _filter_url_slug(spark, d):
    return filter_url_slug(table(spark, d, "pages"), ["Blog", "/de/"]).select("page_id", "url")


@query("redact_url", """SELECT page_id,
  CASE WHEN contains(url, '?') THEN regexp_replace(regexp_replace(url, '([?&]page=)[^&#]*', '\\1***'),
       '([?&]ref=)[^&#]*', '\\1***') ELSE url END AS safe
FROM pages""")
def _redact_url(spark, d):
    return table(spark, d, "pages").select(
        "page_id", U.redact_url(F.col("url"), ("page", "ref")).alias("safe"))


# --- requirement headings ----------------------------------------------------------
# The texts hold no real headings, so frequent phrases stand in for them.

MARKERS = ("that the", "und der", "de la", "que el", "it is", "of the", "les")
ALT = "|".join(MARKERS)
PREFIX_SQL = (
    r"length(regexp_extract(lower(description), '(?s)\A(|.*?[^\p{L}\p{N}])(?:" + ALT
    + r")(?:[^.]|\z)', 1))")
BODY_SQL = """CASE WHEN cut > 0 THEN substring(description, cut + 1) || ' ' || substring(description, 1, cut)
     ELSE description END"""


def _with_cut(spark, d):
    return posting(spark, d).withColumn("cut", T.marker_prefix_length(F.col("description"), MARKERS))


@query("find_marker", f"WITH {POSTING_SQL} SELECT id, {PREFIX_SQL} AS cut FROM posting")
def _find_marker(spark, d):
    return _with_cut(spark, d).select("id", F.col("cut").cast("bigint").alias("cut"))


@query("reorder_description", f"""WITH {POSTING_SQL}
SELECT id, md5({BODY_SQL}) AS body_md5, length({BODY_SQL}) AS n_chars
FROM (SELECT id, description, {PREFIX_SQL} AS cut FROM posting)""")
def _reorder(spark, d):
    body = T.reorder_description(F.col("description"), F.col("cut"))
    return _with_cut(spark, d).select("id", body.alias("b")).select(
        "id", F.md5("b").alias("body_md5"), F.length("b").cast("bigint").alias("n_chars"))


@query("embedding_text", f"""WITH {POSTING_SQL}
SELECT id, md5('passage: ' || title || chr(10) || chr(10) || {BODY_SQL}) AS passage_md5
FROM (SELECT id, title, description, {PREFIX_SQL} AS cut FROM posting)""")
def embedding_text_query(spark, d):
    text = T.embedding_text(F.col("title"), F.col("description"), F.col("cut"))
    return _with_cut(spark, d).select("id", F.md5(text).alias("passage_md5"))


WORDS_SQL = r"len(regexp_extract_all({}, '\S+'))"


@query("embedding_budget", f"""WITH {POSTING_SQL}
SELECT location, count(*) AS n, count(*) FILTER (WHERE cut > 0) AS moved,
  count(*) FILTER (WHERE words > 512) AS over_budget,
  count(*) FILTER (WHERE cut > 0 AND before >= 512) AS rescued
FROM (SELECT *, {WORDS_SQL.format('description')} AS words,
             {WORDS_SQL.format('substring(description, 1, cut)')} AS before
      FROM (SELECT location, description, {PREFIX_SQL} AS cut FROM posting))
GROUP BY location""")
def _embedding_budget(spark, d):
    """How many postings a 512-word budget cuts, and how many the reordering rescues."""
    def words(text):
        return F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)))

    rows = _with_cut(spark, d).select(
        "location", "cut", words("description").alias("words"),
        words(F.substr("description", F.lit(1), F.col("cut"))).alias("before"))
    return rows.groupBy("location").agg(
        row_count(), F.count_if(F.col("cut") > 0).alias("moved"),
        F.count_if(F.col("words") > 512).alias("over_budget"),
        F.count_if((F.col("cut") > 0) & (F.col("before") >= 512)).alias("rescued"))


@query("truncate", f"""SELECT doc_id, md5(substring(text, 1, {PROMPT_DESCRIPTION_LIMIT})) AS cut_md5
FROM documents""")
def _truncate(spark, d):
    """The truncation itself is the feature here (prompt budget)."""
    return table(spark, d, "documents").select(
        "doc_id", F.md5(T.truncate(F.col("text"), PROMPT_DESCRIPTION_LIMIT)).alias("cut_md5"))


@query("highlight_lines", r"""SELECT doc_id, line FROM (
  SELECT doc_id, unnest(str_split(text, chr(10))) AS line FROM documents)
WHERE regexp_matches(line, '[^\t-\r\x{001C}-\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]')""")
def _highlight_lines(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", F.explode(T.highlight_lines(F.col("text"))).alias("line"))


@query("haystack", f"""WITH {POSTING_SQL}
SELECT id, md5(lower(title || ' ' || description || ' ' || array_to_string(tags, ','))) AS training_md5,
       md5(lower(title || ' ' || description || ' ' || array_to_string(tags, ' '))) AS scoring_md5
FROM posting""")
def _haystack(spark, d):
    def hay(separator):
        return F.md5(T.haystack(F.col("title"), F.col("description"), F.col("tags"), separator))

    return posting(spark, d).select(
        "id", hay(",").alias("training_md5"), hay(" ").alias("scoring_md5"))


@query("strip_footer_multi", """SELECT doc_id, md5(regexp_replace(text, '\\A\\s+|\\s+\\z', '', 'g')) AS text_md5
FROM documents""")
def _strip_footer_multi(spark, d):
    """Every text with one of the footer variants appended comes back without it."""
    variant = (
        F.when(F.col("lang") == "en", F.lit("\n Find Jobs in Germany on Arbeitnow"))
        .when(F.col("lang") == "de", F.lit(" Find more English Speaking Jobs in United Kingdom on Arbeitnow."))
        .otherwise(F.lit("Find more German Speaking Jobs in France on Arbeitnow \n")))
    stripped = T.strip_footer_multi(F.concat("text", variant))
    return table(spark, d, "documents").select("doc_id", F.md5(stripped).alias("text_md5"))


@query("strip_footer_fixed", """SELECT doc_id, md5(regexp_replace(text, '\\A\\s+|\\s+\\z', '', 'g')) AS text_md5
FROM documents""")
def _strip_footer_fixed(spark, d):
    stripped = T.strip_footer_fixed(F.concat("text", F.lit("\n Відгукнутись на вакансію. ")))
    return table(spark, d, "documents").select("doc_id", F.md5(stripped).alias("text_md5"))


# --- packed titles -----------------------------------------------------------------

def packed_parts(spark, d):
    """Feed titles packed from the part table, every salary shape among them."""
    low = F.floor("p_retailprice").cast("int")
    salary = (
        F.when(F.col("p_size") % 5 == 0, F.format_string("$%d–%d", low, low * 2))
        .when(F.col("p_size") % 5 == 1, F.format_string("$%d-%d", low * 2, low))
        .when(F.col("p_size") % 5 == 2, F.format_string("від $%d", low))
        .when(F.col("p_size") % 5 == 3, F.format_string("до $%d", low)))
    return table(spark, d, "part").select("p_partkey", "p_size", salary.alias("salary"), F.concat_ws(
        ", ",
        F.concat("p_name", F.lit(" в Glovo в "), "p_brand"),
        salary, "p_type",
        F.when(F.col("p_size") > 25, F.lit("за кордоном")),
        F.when(F.col("p_size") % 2 == 0, F.lit("віддалено")),
    ).alias("raw"))


LOW_SQL = """CASE p_size % 5 WHEN 0 THEN floor(p_retailprice) WHEN 1 THEN floor(p_retailprice)
  WHEN 2 THEN floor(p_retailprice) END"""
HIGH_SQL = """CASE p_size % 5 WHEN 0 THEN floor(p_retailprice) * 2 WHEN 1 THEN floor(p_retailprice) * 2
  WHEN 3 THEN floor(p_retailprice) END"""


@query("parse_packed_title", f"""SELECT p_partkey, p_name || ' в Glovo' AS title, p_brand AS company,
  p_type || CASE WHEN p_size > 25 THEN ', за кордоном' ELSE '' END AS location,
  p_size % 2 = 0 AS remote, {LOW_SQL} AS salary_min, {HIGH_SQL} AS salary_max,
  CASE WHEN p_size % 5 < 4 THEN 'USD' ELSE '' END AS salary_currency
FROM part""")
def _parse_packed_title(spark, d):
    return packed_parts(spark, d).select(
        "p_partkey", parse_packed_title(F.col("raw")).alias("t")).select("p_partkey", "t.*")


@query("parse_salary_text", f"""SELECT p_partkey, {LOW_SQL} AS low, {HIGH_SQL} AS high FROM part""")
def _parse_salary_text(spark, d):
    return packed_parts(spark, d).select(
        "p_partkey", parse_salary_text(F.col("salary")).alias("s")).select("p_partkey", "s.low", "s.high")


# --- profiles ----------------------------------------------------------------------

def profile_documents(spark, d):
    """One profile document per customer; a negative balance gives a broken date."""
    text = F.struct
    job = text(
        F.lit("Buyer").alias("title"), F.concat(F.lit("Nation "), "c_nationkey").alias("company"),
        F.lit("").alias("location"),
        F.when(F.col("c_acctbal") < 0, F.lit("2020-13-40")).otherwise(F.lit("2020-01-15")).alias("start_date"),
        F.when(F.col("c_nationkey") > 12, F.lit("2023-06-30")).alias("end_date"),
        F.concat(F.lit("bought "), "c_mktsegment", F.lit("\n\nsold things")).alias("highlights"))
    school = text(F.lit("School").alias("institution"), F.lit("BA").alias("degree"),
                  F.col("c_mktsegment").alias("field"), F.lit("2010-09-01").alias("start_date"))
    skills = F.array(
        text(F.col("c_mktsegment").alias("name"), F.lit("segment").alias("category")),
        text(F.concat(F.lit("nation "), "c_nationkey").alias("name"), F.lit("place").alias("category")))
    return table(spark, d, "customer").select("c_custkey", F.to_json(text(
        F.col("c_name").alias("full_name"), F.concat(F.lit("buys "), "c_mktsegment").alias("summary"),
        F.concat("c_name", F.lit("@example.test")).alias("email"), skills.alias("skills"),
        F.array(job).alias("experiences"), F.array(school).alias("educations"))).alias("payload"))


def profiles(spark, d):
    documents = from_payload(profile_documents(spark, d), PROFILE_FILE)
    return scan_profile(documents, F.col("c_custkey"))


PROFILE_SQL = """profile AS (
  SELECT c_custkey AS id, c_name AS full_name, c_name || '@example.test' AS email,
         'buys ' || c_mktsegment AS summary, c_mktsegment || ', nation ' || c_nationkey AS skills,
         'Nation ' || c_nationkey AS company, c_mktsegment AS field,
         CASE WHEN c_nationkey > 12 THEN DATE '2023-06-30' END AS end_date,
         'bought ' || c_mktsegment || chr(10) || chr(10) || 'sold things' AS highlights
  FROM customer WHERE c_acctbal >= 0)"""


@query("scan_profile", f"""WITH {PROFILE_SQL}
SELECT id, full_name, email, '' AS phone, summary, skills, company, DATE '2020-01-15' AS start_date,
       end_date, field, 1 AS n_educations FROM profile""")
def _scan_profile(spark, d):
    good, _ = profiles(spark, d)
    return good.select(
        "id", "full_name", "email", "phone", "summary",
        F.array_join(F.transform("skills", lambda s: s["name"]), ", ").alias("skills"),
        F.col("experiences")[0]["company"].alias("company"),
        F.col("experiences")[0]["start_date"].alias("start_date"),
        F.col("experiences")[0]["end_date"].alias("end_date"),
        F.col("educations")[0]["field"].alias("field"), F.size("educations").alias("n_educations"))


@query("scan_profile_quarantine", "SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def _scan_profile_quarantine(spark, d):
    return profiles(spark, d)[1].select("c_custkey")


@query("first_profile", f"WITH {PROFILE_SQL} SELECT id, full_name FROM profile ORDER BY id LIMIT 1")
def _first_profile(spark, d):
    return first_profile(profiles(spark, d)[0]).select("id", "full_name")


@query("profile_query_text", f"""WITH {PROFILE_SQL}
SELECT id, md5('query: ' || summary || chr(10) || 'Skills: ' || skills || chr(10) ||
               'Buyer at ' || company || ': ' || highlights) AS query_md5 FROM profile""")
def _profile_query_text(spark, d):
    good, _ = profiles(spark, d)
    row = F.struct("summary", "skills", "experiences")
    return good.select("id", F.md5(profile_query_text(row)).alias("query_md5"))


JOBS_SQL = ("'- Buyer at ' || f.company || ' (2020-01-15–' || coalesce(CAST(f.end_date AS VARCHAR), 'present')"
            " || '): ' || f.highlights")


def _prompt_sql(template: str, *values: str) -> str:
    parts = template.split("%s")
    quoted = ["'" + p.replace("'", "''") + "'" for p in parts]
    out = [quoted[0]]
    for value, text in zip(values, quoted[1:], strict=True):
        out += [value, text]
    return " || ".join(out)


DESCRIPTION_SQL = f"substring(p.description, 1, {PROMPT_DESCRIPTION_LIMIT})"


PAIRED_SQL = """numbered AS (
  SELECT *, row_number() OVER (ORDER BY id) - 1 AS place, count(*) OVER () AS n FROM profile)"""
PAIRS_SQL = "posting p JOIN numbered f ON p.id % f.n = f.place"


def _pairs(spark, d):
    """Every posting beside a profile: they take the profiles in turn."""
    good, _ = profiles(spark, d)
    listed = number_rows(good.withColumn("_all", F.lit(0)), ["_all"], "id", "place").drop("_all")
    n = good.agg(F.count(F.lit(1)).alias("n")).scalar()
    rows = posting(spark, d).withColumn("place", F.col("id") % n)
    return rows.alias("p").join(listed.alias("f"), "place").select(
        F.col("p.id").alias("id"), F.struct("p.*").alias("posting"), F.struct("f.*").alias("profile"))


@query("prompt_text", f"""WITH {POSTING_SQL}, {PROFILE_SQL}, {PAIRED_SQL}
SELECT p.id, md5({_prompt_sql(
    SCORING_PROMPT, 'f.summary', 'f.skills', JOBS_SQL, 'p.title', 'p.company', 'p.location',
    "CASE WHEN p.remote THEN 'True' ELSE 'False' END", DESCRIPTION_SQL)}) AS prompt_md5
FROM {PAIRS_SQL}""")
def _prompt_scoring(spark, d):
    return _pairs(spark, d).select(
        "id", F.md5(scoring_prompt(F.col("posting"), F.col("profile"))).alias("prompt_md5"))


@query("prompt_text_writing", f"""WITH {POSTING_SQL}, {PROFILE_SQL}, {PAIRED_SQL}
SELECT p.id, md5({_prompt_sql(
    WRITING_CONTEXT, 'f.full_name', 'f.email', "''", 'f.summary', 'f.skills', JOBS_SQL, 'p.title',
    'p.company', DESCRIPTION_SQL)}) AS prompt_md5
FROM {PAIRS_SQL}""")
def _prompt_writing(spark, d):
    return _pairs(spark, d).select(
        "id", F.md5(writing_context(F.col("posting"), F.col("profile"))).alias("prompt_md5"))


# --- dates -------------------------------------------------------------------------

@query("epoch_to_ts", """SELECT event_id, CASE WHEN user_id % 10 <> 0
  THEN CAST(floor(epoch(ts)) AS BIGINT) END AS second FROM events""")
def _epoch_to_ts(spark, d):
    epoch = F.unix_seconds(F.col("ts").cast("timestamp"))
    given = F.when(F.col("user_id") % 10 == 0, F.lit(0)).otherwise(epoch)
    return table(spark, d, "events").select(
        "event_id", F.unix_seconds(V.epoch_to_ts(given)).alias("second"))


@query("rfc2822_to_epoch", """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P'
  THEN CAST(epoch(o_orderdate) AS BIGINT) - CASE WHEN o_orderstatus = 'F' THEN 7200 ELSE 0 END END AS epoch
FROM orders""")
def _rfc2822(spark, d):
    day = F.date_format("o_orderdate", "E, dd MMM yyyy HH:mm:ss")
    text = (
        F.when(F.col("o_orderstatus") == "F", F.concat(day, F.lit(" +0200")))
        .when(F.col("o_orderstatus") == "O", F.concat(day, F.lit(" GMT")))
        .otherwise(F.lit("some day")))
    return table(spark, d, "orders").select("o_orderkey", V.rfc2822_to_epoch(text).alias("epoch"))


@query("iso_date", """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS day
FROM orders""")
def _iso_date(spark, d):
    text = F.when(F.col("o_orderstatus") == "P", F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, d, "orders").select("o_orderkey", V.iso_date(text).alias("day"))


@query("month_label", """SELECT label, count(*) AS n FROM (
  SELECT CASE WHEN o_orderstatus = 'P' THEN 'Present' ELSE strftime(o_orderdate, '%m/%Y') END AS label
  FROM orders) GROUP BY label""")
def _month_label(spark, d):
    day = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))
    return table(spark, d, "orders").groupBy(V.month_label(day).alias("label")).agg(row_count())


# --- money and scores --------------------------------------------------------------

PERIOD_SQL = """CASE o_orderpriority WHEN '1-URGENT' THEN 'hour' WHEN '2-HIGH' THEN 'month'
  WHEN '3-MEDIUM' THEN 'year' ELSE '' END"""


def salaries(spark, d):
    """Orders priced as salaries; pending ones miss the upper bound."""
    period = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "hour")
        .when(F.col("o_orderpriority") == "2-HIGH", "month")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "year").otherwise(""))
    return table(spark, d, "orders").select(
        "o_orderkey", period.alias("salary_period"), F.col("o_totalprice").alias("salary_min"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") * 1.5).alias("salary_max"),
        F.lit("PLN").alias("salary_currency"), (F.col("o_orderstatus") == "F").alias("salary_is_predicted"),
        (F.col("o_orderkey") % 101).cast("int").alias("score"))


SALARY_SQL = f"""salaries AS (
  SELECT o_orderkey, {PERIOD_SQL} AS period, o_totalprice AS low,
         CASE WHEN o_orderstatus <> 'P' THEN o_totalprice * 1.5 END AS high,
         o_orderstatus = 'F' AS predicted, CAST(o_orderkey % 101 AS INTEGER) AS score
  FROM orders)"""
HOURLY = HOURS_PER_DAY * DAYS_PER_MONTH


def monthly_sql(amount: str) -> str:
    return (f"CASE WHEN high IS NULL THEN NULL WHEN period = 'year' THEN {amount} / 12 "
            f"WHEN period = 'hour' THEN {amount} * CAST({HOURLY} AS DOUBLE) ELSE {amount} END")


@query("monthly_salary", f"""WITH {SALARY_SQL}
SELECT o_orderkey, {monthly_sql('low')} AS low, {monthly_sql('high')} AS high FROM salaries""")
def _monthly_salary(spark, d):
    m = V.monthly_salary(F.col("salary_min"), F.col("salary_max"), F.col("salary_period"))
    return salaries(spark, d).select("o_orderkey", m.alias("m")).select(
        "o_orderkey", "m.low", "m.high")


@query("salary_normalised", f"""WITH {SALARY_SQL}
SELECT period AS salary_period, count(*) AS n, count({monthly_sql('low')}) AS known,
       min({monthly_sql('low')}) AS lowest, max({monthly_sql('high')}) AS highest
FROM salaries GROUP BY period""")
def _salary_normalised(spark, d):
    m = V.monthly_salary(F.col("salary_min"), F.col("salary_max"), F.col("salary_period"))
    return salaries(spark, d).select("salary_period", m.alias("m")).groupBy("salary_period").agg(
        row_count(), F.count("m").alias("known"), F.min("m.low").alias("lowest"),
        F.max("m.high").alias("highest"))


def money_sql(amount: str) -> str:
    return f"format('{{:,}}', CAST(round_even({amount}, 0) AS BIGINT))"


@query("project_posting_card", f"""WITH {SALARY_SQL}
SELECT o_orderkey, score,
  CASE WHEN high IS NOT NULL THEN {money_sql('low')} || '–' || {money_sql('high')}
       ELSE 'from ' || {money_sql('low')} END || ' PLN' ||
  CASE WHEN period <> '' THEN '/' || period ELSE '' END ||
  CASE WHEN predicted THEN ' (estimated)' ELSE '' END AS salary_label,
  {monthly_sql('low')} AS monthly_min, {monthly_sql('high')} AS monthly_max,
  CASE WHEN score >= 70 THEN 'high' WHEN score >= 40 THEN 'mid' ELSE 'low' END AS band
FROM salaries""")
def _posting_card(spark, d):
    return posting_card(salaries(spark, d)).select(
        "o_orderkey", "score", "salary_label", "monthly_min", "monthly_max", "band")


@query("score_band", f"""WITH {SALARY_SQL}
SELECT CASE WHEN score >= 70 THEN 'high' WHEN score >= 40 THEN 'mid' ELSE 'low' END AS band, count(*) AS n
FROM salaries GROUP BY 1""")
def _score_band(spark, d):
    return salaries(spark, d).groupBy(V.score_band(F.col("score")).alias("band")).agg(row_count())


@query("display_score", """SELECT o_orderkey, greatest(0, least(100,
  CAST(round_even((CAST(o_orderkey % 1000 AS DOUBLE) / 1000) * 100, 0) AS INTEGER)
  + CAST((o_custkey % 5 - 2) * 10 AS INTEGER))) AS score FROM orders""")
def _display_score(spark, d):
    raw = (F.col("o_orderkey") % 1000).cast("double") / 1000
    adjustment = ((F.col("o_custkey") % 5 - 2) * 10).cast("int")
    return table(spark, d, "orders").select(
        "o_orderkey", V.display_score(raw, adjustment).alias("score"))


@query("cosine_score", """WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings ORDER BY vec_id LIMIT 1)
SELECT vec_id, round((1.0 + list_cosine_similarity(CAST(embedding AS DOUBLE[]), q)) / 2, 6) AS raw
FROM embeddings, q""")
def _cosine_score(spark, d):
    vector = F.lit(profile_vector(spark, d))
    return table(spark, d, "embeddings").select(
        "vec_id", F.round(cosine_score(cosine(F.col("embedding"), vector)), 6).alias("raw"))


# --- maps, tags, JSON ----------------------------------------------------------------

CODES = [*COUNTRY_CURRENCY, "xx", "yy", "zz", "qq", "ww", "vv"]


@query("map_lookup_default", f"""SELECT code, currency, count(*) AS n FROM (
  SELECT code, coalesce(MAP {{{', '.join(f"'{k}': '{v}'" for k, v in COUNTRY_CURRENCY.items())}}}[code], '')
           AS currency
  FROM (SELECT [{', '.join(f"'{c}'" for c in CODES)}][c_nationkey + 1] AS code FROM customer))
GROUP BY ALL""")
def _map_lookup(spark, d):
    code = F.element_at(F.array(*[F.lit(c) for c in CODES]), F.col("c_nationkey") + 1)
    return table(spark, d, "customer").select(code.alias("code")).groupBy(
        "code", V.country_currency(F.col("code")).alias("currency")).agg(row_count())


@query("json_path_or_default", """SELECT event_id, CAST(props ->> '$.k' AS INTEGER) AS k, '' AS missing FROM events""")
def _json_path(spark, d):
    doc = F.from_json("props", "k int, deep struct<name:string>")
    return table(spark, d, "events").select("event_id", doc.alias("doc")).select(
        "event_id", "doc.k", V.clean_text(F.col("doc.deep.name")).alias("missing"))


@query("tags_join", "SELECT doc_id, lang || ',,' || source AS tags FROM documents")
def _tags_join(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", V.tags_join(F.array("lang", F.lit(""), "source")).alias("tags"))


@query("tags_split", """SELECT tag, count(*) AS n FROM (
  SELECT unnest([lang, source]) AS tag FROM documents) GROUP BY tag""")
def _tags_split(spark, d):
    stored = V.tags_join(F.array("lang", F.lit(""), "source"))
    return table(spark, d, "documents").select(
        F.explode(V.tags_split(stored)).alias("tag")).groupBy("tag").agg(row_count())
