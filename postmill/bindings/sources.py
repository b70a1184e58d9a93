"""Feed, sitemap and page parsing over payloads that Spark builds from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.filters import filter_sources
from ..schemas import JSON_PAGE, JSON_TAGGED_PAGE
from ..sources import feeds, normalize, pages
from .registry import query
from .tables import (
    row_count, table,
)
from .text import HIGH_SQL, HOST_SQL, LOW_SQL, html_sql, packed_parts



def _json(struct):
    return F.to_json(struct, {"ignoreNullFields": "false"})


# --- JSON search pages: one page with two jobs per document -----------------------------

def search_pages(spark, d):
    """The second job of a page has explicit nulls where the first has values."""
    none = F.lit(None).cast("string")

    def job(suffix, company, location, category, predicted, low):
        return F.struct(
            F.concat("doc_id", F.lit(suffix)).alias("id"),
            F.substring_index("text", "\n", 1).alias("title"),
            F.struct(company.alias("display_name")).alias("company"),
            F.struct(location.alias("display_name")).alias("location"),
            F.concat(F.lit("https://example.test/"), "doc_id").alias("redirect_url"),
            F.col("text").alias("description"), F.struct(category.alias("label")).alias("category"),
            F.lit("2024-01-05T10:00:00Z").alias("created"), low.alias("salary_min"),
            F.col("n_chars").cast("double").alias("salary_max"), predicted.alias("salary_is_predicted"))

    first = job("-a", F.col("source"), F.col("lang"), F.lit("IT Jobs"), F.lit("1"),
                (F.col("n_chars") / 2).cast("double"))
    second = job("-b", none, none, none, none, F.lit(None).cast("double"))
    payloads = table(spark, d, "documents").select(
        "lang", _json(F.struct(F.array(first, second).alias("results"))).alias("payload"))
    return feeds.from_payload(payloads, JSON_PAGE)


def json_jobs(spark, d):
    country = F.when(F.col("lang") == "en", F.lit("gb")).otherwise(F.col("lang"))
    return feeds.scan_json_jobs(search_pages(spark, d), country)


JSON_JOBS_SQL = """json_jobs AS (
  SELECT doc_id || s AS external_id, split_part(text, chr(10), 1) AS title,
         CASE WHEN s = '-a' THEN source ELSE '' END AS company,
         CASE WHEN s = '-a' THEN lang ELSE '' END AS location, 'https://example.test/' || doc_id AS url,
         text AS description, CASE WHEN s = '-a' THEN 'IT Jobs' ELSE '' END AS category,
         CASE WHEN s = '-a' THEN n_chars / 2 END AS salary_min, CAST(n_chars AS DOUBLE) AS salary_max,
         CASE lang WHEN 'en' THEN 'GBP' ELSE 'EUR' END AS salary_currency, s = '-a' AS salary_is_predicted
  FROM documents, (VALUES ('-a'), ('-b')) v(s))"""


@query("scan_json_jobs", f"""WITH {JSON_JOBS_SQL}
SELECT external_id, md5(title) AS title_md5, company, location, url, md5(description) AS description_md5,
       category, 1704448800 AS created, salary_min, salary_max, salary_currency, 'year' AS salary_period,
       salary_is_predicted FROM json_jobs""")
def _scan_json_jobs(spark, d):
    return json_jobs(spark, d).select(
        "external_id", F.md5("title").alias("title_md5"), "company", "location", "url",
        F.md5("description").alias("description_md5"), "category",
        F.unix_seconds("created_at").cast("int").alias("created"), "salary_min", "salary_max",
        "salary_currency", "salary_period", "salary_is_predicted")


# --- tagged JSON pages: escaped page markup with a platform footer --------------------------

KEYWORDS = ("die", "LES", "los")


def escaped(html):
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        html = F.replace(html, F.lit(raw), F.lit(name))
    return html


def escaped_sql(html: str) -> str:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        html = f"replace({html}, '{raw}', '{name}')"
    return html


def tagged_pages(spark, d):
    job = F.struct(
        F.concat(F.lit("job-"), "page_id").alias("slug"), F.lit("Acme").alias("company_name"),
        F.concat(F.lit("Job "), "page_id").alias("title"),
        F.concat(escaped(F.col("html")), F.lit(" Find Jobs in Germany on Arbeitnow")).alias("description"),
        (F.col("page_id") % 2 == 0).alias("remote"), F.col("url").alias("url"),
        F.array(F.lit("php"), F.lit("web")).alias("tags"), F.lit("Berlin").alias("location"),
        (F.col("page_id") * 86400).alias("created_at"))
    payloads = table(spark, d, "pages").select(
        _json(F.struct(F.array(job).alias("data"))).alias("payload"))
    return feeds.from_payload(payloads, JSON_TAGGED_PAGE)


def tagged_jobs(spark, d):
    return feeds.scan_json_jobs_tagged(tagged_pages(spark, d), KEYWORDS)


TAGGED_SQL = f"""tagged AS (
  SELECT *, 'job-' || page_id AS external_id FROM (
    SELECT *, lower('job ' || page_id || ' ' || {escaped_sql('html')} || ' php web') AS hay FROM pages)
  WHERE contains(hay, 'die') OR contains(hay, 'les') OR contains(hay, 'los'))"""


@query("scan_json_jobs_tagged", f"""WITH {TAGGED_SQL}
SELECT external_id, 'Job ' || page_id AS title, 'Acme' AS company, page_id % 2 = 0 AS remote, url,
       md5({escaped_sql('html')} || ' Find Jobs in Germany on Arbeitnow') AS description_md5,
       'php,web' AS tags, page_id * 86400 AS created_epoch FROM tagged""")
def _scan_json_jobs_tagged(spark, d):
    return tagged_jobs(spark, d).select(
        "external_id", "title", "company", "remote", "url", F.md5("description").alias("description_md5"),
        F.array_join("tags", ",").alias("tags"), "created_epoch")


# --- RSS items packed from the part table ----------------------------------------------------

def rss_payloads(spark, d):
    """Every seventh size lacks the link, the next one has a link without an id."""
    link = (
        F.when(F.col("p_size") % 7 == 0, F.lit(""))
        .when(F.col("p_size") % 7 == 1, F.lit("<link>https://jobs.example.test/about/</link>"))
        .otherwise(F.concat(
            F.lit("<link>https://jobs.example.test/companies/x/vacancies/"), "p_partkey",
            F.lit("/?utm_source=feed&amp;x=1</link>"))))
    stamp = F.timestamp_seconds(F.lit(1704067200) + F.col("p_partkey") * 60)
    return packed_parts(spark, d).select(F.concat(
        F.lit("<item><title>R&amp;amp;D "), "raw", F.lit("</title>"), link,
        F.lit("<description>&lt;p&gt;Uses Span&amp;lt;T&amp;gt;&lt;/p&gt;&lt;p&gt;Відгукнутись на вакансію&lt;/p&gt;"
              "</description><pubDate>"),
        F.date_format(stamp.cast("timestamp_ntz"), "E, dd MMM yyyy HH:mm:ss"),
        F.lit(" +0000</pubDate></item>")).alias("payload"))


def rss_jobs(spark, d):
    return feeds.scan_rss_items(feeds.rss_items(rss_payloads(spark, d)))


RSS_SQL = f"""rss AS (
  SELECT CAST(p_partkey AS VARCHAR) AS external_id, 'R&D ' || p_name || ' в Glovo' AS title,
         p_brand AS company, p_type || CASE WHEN p_size > 25 THEN ', за кордоном' ELSE '' END AS location,
         p_size % 2 = 0 AS remote,
         'https://jobs.example.test/companies/x/vacancies/' || p_partkey || '/' AS url,
         1704067200 + p_partkey * 60 AS created_epoch, {LOW_SQL} AS salary_min, {HIGH_SQL} AS salary_max,
         CASE WHEN p_size % 5 < 4 THEN 'USD' ELSE '' END AS salary_currency
  FROM part WHERE p_size % 7 >= 2)"""


@query("scan_rss_items", f"""WITH {RSS_SQL} SELECT *,
  '<p>Uses Span&lt;T&gt;</p><p>Відгукнутись на вакансію</p>' AS description FROM rss""")
def _scan_rss_items(spark, d):
    return rss_jobs(spark, d)


# --- sitemaps ----------------------------------------------------------------------------------

@query("scan_sitemap_urls", """
WITH named AS (SELECT DISTINCT page_id % 50 AS part FROM pages WHERE url LIKE 'https:%')
SELECT unnest([url, url || '&again=1']) AS url FROM pages WHERE page_id % 50 IN (SELECT part FROM named)""")
def _scan_sitemap_urls(spark, d):
    """Fifty part names; the index names a part when one of its pages is on https."""
    part = F.concat(F.lit("https://example.test/part-"), F.col("page_id") % 50, F.lit(".xml"))
    url = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    index = table(spark, d, "pages").filter(F.col("url").startswith("https:")).select(F.concat(
        F.lit("<sitemapindex><sitemap><loc>"), part, F.lit("</loc></sitemap></sitemapindex>")).alias("payload"))
    parts = table(spark, d, "pages").select(part.alias("part_url"), F.concat(
        F.lit("<urlset><url><loc>"), url, F.lit("</loc></url><url><loc>"), url,
        F.lit("&amp;again=1</loc></url></urlset>")).alias("payload"))
    return feeds.scan_sitemap_urls(index, parts)


# --- listing pages --------------------------------------------------------------------------------

LINK = 'href="(/[^"]*)"'


@query("extract_listing_links", f"""
WITH listing AS (SELECT {HOST_SQL} AS crawl, page_id AS page, contains(url, 'utm_source') AS bad,
                        regexp_extract_all(html, '{LINK}', 1) AS links FROM pages),
stops AS (SELECT crawl, min(page) AS stop FROM listing WHERE bad OR len(links) = 0 GROUP BY 1),
found AS (SELECT l.crawl, page, unnest(links) AS path, generate_subscripts(links, 1) - 1 AS pos
          FROM listing l LEFT JOIN stops s ON s.crawl = l.crawl WHERE stop IS NULL OR page < stop)
SELECT crawl, 'https://x.test' || path AS url, min(page) AS page,
       CAST(arg_min(pos, page * 100000 + pos) AS INTEGER) AS pos FROM found GROUP BY crawl, path""")
def _extract_listing_links(spark, d):
    """One crawl per host; a page with a tracking parameter counts as redirected."""
    host = F.lower(F.regexp_extract("url", "://([^/?#]*)", 1))
    listing = table(spark, d, "pages").select(
        host.alias("crawl"), F.col("page_id").alias("page"), "html", F.lit(200).alias("status"),
        F.col("url").contains("utm_source").alias("was_redirected"))
    return pages.extract_listing_links(listing, LINK, "https://x.test")


# --- pages with JSON-LD -----------------------------------------------------------------------------

def jsonld_pages(spark, d):
    """Blocks are appended to the real pages; the page number decides their shape.

    Remainder by four: 0 one posting, 1 a breadcrumb before it, 2 a malformed block
    before it, 3 only a breadcrumb.
    """
    n = F.col("page_id")
    locality = F.when(n % 3 == 0, F.lit('["Kyiv","Lviv"]')).otherwise(F.lit('"Warsaw"'))
    salary = F.when(n % 5 == 0, F.lit("null")).otherwise(F.format_string(
        '{"currency":"USD","value":{"minValue":%d,"maxValue":%d,"unitText":"MONTH"}}', n, n * 2))
    posted = F.when(n % 10 == 9, F.lit("some day")).otherwise(F.lit("2024-01-05T10:00:00Z"))
    job = F.concat(
        F.lit('{"@type":"JobPosting","title":"Job '), n, F.lit('","hiringOrganization":{"name":"Org '), n % 7,
        F.lit('"},"jobLocation":{"address":{"addressLocality":'), locality, F.lit(',"addressCountry":'),
        F.when(n % 2 == 0, F.lit('"UA"')).otherwise(F.lit("null")), F.lit('}},"jobLocationType":'),
        F.when(n % 4 == 0, F.lit('"TELECOMMUTE"')).otherwise(F.lit("null")),
        F.lit(',"description":"Text '), n, F.lit('","datePosted":"'), posted,
        F.lit('","url":"https://djinni.co/jobs/'), n, F.lit('-job/","baseSalary":'), salary, F.lit("}"))

    def block(body):
        return F.concat(F.lit("\n<script type='application/ld+json' id=\"x\">"), body, F.lit("</script>"))

    crumb = block(F.lit('{"@type":"BreadcrumbList","title":"Crumb"}'))
    tail = (
        F.when(n % 4 == 0, block(job))
        .when(n % 4 == 1, F.concat(crumb, block(job)))
        .when(n % 4 == 2, F.concat(block(F.lit("{broken")), block(job)))
        .otherwise(crumb))
    return table(spark, d, "pages").select("url", F.concat("html", tail).alias("html"), F.lit(200).alias("status"))


@query("extract_jsonld", """SELECT url, 'Job ' || page_id AS title FROM pages WHERE page_id % 4 IN (0, 1)""")
def _extract_jsonld(spark, d):
    return pages.extract_jsonld(jsonld_pages(spark, d)).select(
        "url", F.try_variant_get("job", "$.title", "string").alias("title"))


@query("extract_jsonld_fallback", """SELECT url, CASE WHEN page_id % 4 = 3 THEN 'Crumb' ELSE 'Job ' || page_id END
  AS title FROM pages WHERE page_id % 4 <> 2""")
def _extract_jsonld_fallback(spark, d):
    return pages.extract_jsonld(jsonld_pages(spark, d), fall_back_to_first=True).select(
        "url", F.try_variant_get("job", "$.title", "string").alias("title"))


def page_jobs(spark, d, own_url=True):
    blocks = pages.extract_jsonld(jsonld_pages(spark, d), fall_back_to_first=not own_url)
    return pages.jobposting_to_job(blocks, id_from_block_url=own_url)


PAGE_JOBS_SQL = """page_jobs AS (
  SELECT page_id, url AS page_url, CAST(page_id AS VARCHAR) AS external_id, 'Job ' || page_id AS title,
         'Org ' || page_id % 7 AS company,
         CASE WHEN page_id % 3 = 0 THEN 'Kyiv, Lviv' ELSE 'Warsaw' END ||
         CASE WHEN page_id % 2 = 0 THEN ', UA' ELSE '' END AS location, page_id % 4 = 0 AS remote,
         'https://djinni.co/jobs/' || page_id || '-job/' AS url, 'Text ' || page_id AS description,
         1704448800 AS created,
         CASE WHEN page_id % 5 <> 0 THEN CAST(page_id AS DOUBLE) END AS salary_min,
         CASE WHEN page_id % 5 <> 0 THEN CAST(page_id * 2 AS DOUBLE) END AS salary_max,
         CASE WHEN page_id % 5 <> 0 THEN 'USD' ELSE '' END AS salary_currency,
         CASE WHEN page_id % 5 <> 0 THEN 'month' ELSE '' END AS salary_period
  FROM pages WHERE page_id % 4 IN (0, 1) AND page_id % 10 <> 9)"""


@query("jobposting_to_job", f"WITH {PAGE_JOBS_SQL} SELECT * EXCLUDE (page_id, page_url) FROM page_jobs")
def _jobposting_to_job(spark, d):
    return page_jobs(spark, d)[0].withColumn(
        "created", F.unix_seconds("created_at").cast("int")).drop("created_at")


@query("jobposting_quarantine", """SELECT 'https://djinni.co/jobs/' || page_id || '-job/' AS url FROM pages
WHERE page_id % 4 IN (0, 1) AND page_id % 10 = 9""")
def _jobposting_quarantine(spark, d):
    return page_jobs(spark, d)[1].select("url")


# --- one schema ------------------------------------------------------------------------------------------

def batches(spark, d):
    return [
        normalize.normalize_adzuna(json_jobs(spark, d)),
        normalize.normalize_arbeitnow(tagged_jobs(spark, d)),
        normalize.normalize_justjoinit(page_jobs(spark, d, own_url=False)[0]),
        normalize.normalize_dou(rss_jobs(spark, d)),
        normalize.normalize_djinni(page_jobs(spark, d)[0]),
    ]


FALLBACK_SQL = f"""fallback AS (
  SELECT regexp_extract(regexp_replace(url, '/+\\z', ''), '[^/]*\\z') AS external_id, 'Crumb' AS title,
         '' AS company, '' AS location, false AS remote, url, '' AS description, NULL AS created,
         CAST(NULL AS DOUBLE) AS salary_min, CAST(NULL AS DOUBLE) AS salary_max, '' AS salary_currency,
         '' AS salary_period FROM pages WHERE page_id % 4 = 3
  UNION ALL
  SELECT regexp_extract(regexp_replace(page_url, '/+\\z', ''), '[^/]*\\z'), title, company, location, remote,
         page_url, description, created, salary_min, salary_max, salary_currency, salary_period FROM page_jobs)"""
ALL_SQL = f"""{JSON_JOBS_SQL}, {TAGGED_SQL}, {RSS_SQL}, {PAGE_JOBS_SQL}, {FALLBACK_SQL},
everything AS (
  SELECT 'adzuna' AS source, external_id, title, company, location, false AS remote, url, description,
         CASE WHEN category <> '' THEN category ELSE '' END AS tags, 1704448800 AS posted, salary_min, salary_max,
         salary_currency, 'year' AS salary_period, salary_is_predicted FROM json_jobs
  UNION ALL SELECT 'arbeitnow', external_id, 'Job ' || page_id, 'Acme', 'Berlin', page_id % 2 = 0, url,
         {html_sql('html')}, 'php,web', CASE WHEN page_id > 0 THEN page_id * 86400 END, NULL, NULL, '', '', false
         FROM tagged
  UNION ALL SELECT 'justjoinit', external_id, title, company, location, remote, url, description, '', created,
         salary_min, salary_max, salary_currency, salary_period, false FROM fallback
  UNION ALL SELECT 'dou', external_id, title, company, location, remote, url, 'Uses Span<T>', '', created_epoch,
         salary_min, salary_max, salary_currency,
         CASE WHEN salary_min IS NOT NULL OR salary_max IS NOT NULL THEN 'month' ELSE '' END, false FROM rss
  UNION ALL SELECT 'djinni', external_id, title, company, location, remote, url, description, '', created,
         salary_min, salary_max, salary_currency, salary_period, false FROM page_jobs)"""
SHOWN_SQL = """source, external_id, md5(title) AS title_md5, company, location, remote, url,
  md5(description) AS description_md5, tags, CAST(posted AS BIGINT) AS posted, salary_min, salary_max,
  salary_currency, salary_period, salary_is_predicted"""


def _shown(rows):
    return rows.select(
        "source", "external_id", F.md5("title").alias("title_md5"), "company", "location", "remote", "url",
        F.md5("description").alias("description_md5"), F.array_join("tags", ",").alias("tags"),
        F.unix_seconds("posted_at").alias("posted"), "salary_min", "salary_max", "salary_currency",
        "salary_period", "salary_is_predicted")


@query("normalize_source", f"WITH {ALL_SQL} SELECT {SHOWN_SQL} FROM everything")
def _normalize_source(spark, d):
    return _shown(normalize.union_sources(batches(spark, d)).drop("_batch"))


@query("union_sources", f"WITH {ALL_SQL} SELECT source, count(*) AS n FROM everything GROUP BY source")
def _union_sources(spark, d):
    return normalize.union_sources(batches(spark, d)).groupBy("source").agg(row_count())


@query("fetch_all", f"""WITH {ALL_SQL}
SELECT DISTINCT ON (source, external_id) source, external_id, company, location, md5(title) AS title_md5
FROM everything ORDER BY source, external_id, url""")
def _fetch_all(spark, d):
    """Every board, then the RSS board again under other titles: the first one stays.

    Inside a board the URL gives the order.
    """
    first = batches(spark, d)
    again = first[3].withColumn("title", F.lit("again"))
    ordered = [b.withColumn("ordinal", F.col("url")) for b in [*first, again]]
    return normalize.fetch_all(ordered).select(
        "source", "external_id", "company", "location", F.md5("title").alias("title_md5"))


@query("feed_parse", f"""WITH {ALL_SQL} SELECT source, salary_period, count(*) AS n,
  count(salary_min) AS with_salary, count(*) FILTER (WHERE remote) AS remote_jobs
FROM everything WHERE source IN ('dou', 'djinni') GROUP BY ALL""")
def _feed_parse(spark, d):
    rows = filter_sources(normalize.union_sources(batches(spark, d)), ["dou", "djinni"])
    return rows.groupBy("source", "salary_period").agg(
        row_count(), F.count("salary_min").alias("with_salary"), F.count_if("remote").alias("remote_jobs"))
