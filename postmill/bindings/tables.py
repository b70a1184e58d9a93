"""The shared Parquet tables seen through the engine's schemas.

Every view below has a SQL twin used by the oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.upsert import posting_status


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ntz(text: str) -> Column:
    return F.expr(f"TIMESTAMP_NTZ'{text}'")


# --- documents as postings, labels as decisions, embeddings as the index -------

def posting(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("id"),
        "source",
        F.col("doc_id").cast("string").alias("external_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.concat_ws("/", "source", "lang", (F.col("doc_id") % 97).cast("string")).alias("company"),
        F.col("lang").alias("location"),
        (F.col("lang") == "en").alias("remote"),
        F.concat(F.lit("https://example.test/"), F.col("doc_id")).alias("url"),
        F.col("text").alias("description"),
        F.array("lang", "source").alias("tags"),
        (ntz("2024-01-01 00:00:00") + F.make_dt_interval(mins=F.col("n_chars").cast("int")))
        .alias("last_seen_at"),
        F.when(F.col("n_chars") > 4000, F.lit("removed")).otherwise(F.lit("active")).alias("status"),
    )


POSTING_SQL = """posting AS (
  SELECT doc_id AS id, source, CAST(doc_id AS VARCHAR) AS external_id,
         split_part(text, chr(10), 1) AS title, source || '/' || lang || '/' || doc_id % 97 AS company,
         lang AS location, lang = 'en' AS remote, 'https://example.test/' || doc_id AS url,
         text AS description, [lang, source] AS tags,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(n_chars) AS last_seen_at,
         CASE WHEN n_chars > 4000 THEN 'removed' ELSE 'active' END AS status
  FROM documents)"""


def application(spark: SparkSession, d: str) -> DataFrame:
    status = (
        F.when(F.col("toxic") == 1, F.lit("dismissed"))
        .when(F.col("quality") == 0, F.lit("rejected"))
        .when(F.col("doc_id") % 3 == 0, F.lit("applied"))
        .otherwise(F.lit("saved"))
    )
    return table(spark, d, "labels").select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("vacancy_id"), status.alias("status"))


APPLICATION_SQL = """application AS (
  SELECT doc_id AS id, doc_id AS vacancy_id,
         CASE WHEN toxic = 1 THEN 'dismissed' WHEN quality = 0 THEN 'rejected'
              WHEN doc_id % 3 = 0 THEN 'applied' ELSE 'saved' END AS status
  FROM labels)"""


def index(spark: SparkSession, d: str) -> DataFrame:
    """Index documents as the index holds them: id, board and vector.

    Ids leave gaps, and the highest belong to no posting any more.
    """
    return table(spark, d, "embeddings").select(
        (F.col("vec_id") * 7).alias("vacancy_id"),
        F.concat(F.lit("src"), (F.col("vec_id") % 20).cast("string")).alias("source"), "embedding")


INDEX_SQL = """idx AS (
  SELECT vec_id * 7 AS vacancy_id, 'src' || vec_id % 20 AS source,
         CAST(embedding AS DOUBLE[]) AS embedding
  FROM embeddings)"""


def profile_vector(spark: SparkSession, d: str) -> list[float]:
    """The vector of the lowest id stands for the first profile: one row, one array."""
    return table(spark, d, "embeddings").orderBy("vec_id").select("embedding").first()[0]


PROFILE_VECTOR_SQL = """query AS (
  SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings ORDER BY vec_id LIMIT 1)"""

SKILLS = ("trash", "scum", "clown", "idiot", "worthless", "onthon", "the")
LEVELS = ("der", "die", "is", "la", "le", "of", "the", "to")
AS_OF = "2024-01-06 06:00:00"


def words_in_sql(text: str, words) -> str:
    """List of the words found in ``text``; constant patterns, compiled once."""
    cases = ", ".join(
        f"CASE WHEN {mentioned_sql(text, chr(39) + w + chr(39))} THEN '{w}' END" for w in words)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


HAY_SQL = "lower(title || ' ' || description || ' ' || array_to_string(tags, '{sep}'))"
BOUNDARY_SQL = r"regexp_matches({text}, '(?:\A|[^\p{{L}}\p{{N}}])' || {word} || '(?:\z|[^\p{{L}}\p{{N}}])')"


def hay_sql(sep: str = ",") -> str:
    return HAY_SQL.format(sep=sep)


def mentioned_sql(text: str, word: str) -> str:
    return BOUNDARY_SQL.format(text=text, word=word)


# --- orders as a posting table that one batch meets ------------------------------
# The run boundary is a point in time: what was ordered before it is stored, what
# came after is the batch. Key = (priority, customer), so both sides repeat keys.

RUN_START = "1999-01-01 00:00:00"
RUN_AT = "2001-09-01 00:00:00"
RUN_SOURCE = "1-URGENT"


def order_versions(spark: SparkSession, d: str) -> DataFrame:
    return versions_of(table(spark, d, "orders"))


def versions_of(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("o_orderkey").alias("ordinal"),
        F.col("o_orderpriority").alias("source"),
        F.col("o_custkey").cast("string").alias("external_id"),
        F.concat(F.lit("order "), F.col("o_orderstatus")).alias("title"),
        F.concat(F.lit("customer "), F.col("o_custkey")).alias("company"),
        F.lit("").alias("location"),
        (F.col("o_orderstatus") == "O").alias("remote"),
        F.concat(F.lit("https://example.test/order/"), F.col("o_custkey")).alias("url"),
        F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("description"),
        F.array("o_orderstatus").alias("tags"),
        F.col("o_orderdate").alias("posted_at"),
        F.col("o_totalprice").alias("salary_min"),
        (F.col("o_totalprice") * 2).alias("salary_max"),
        F.lit("USD").alias("salary_currency"),
        F.lit("year").alias("salary_period"),
        (F.col("o_orderstatus") == "P").alias("salary_is_predicted"),
    )


def order_batch(spark: SparkSession, d: str) -> DataFrame:
    return order_versions(spark, d).filter(F.col("posted_at") >= ntz(RUN_START))


def order_store(spark: SparkSession, d: str) -> DataFrame:
    old = order_versions(spark, d).filter(F.col("posted_at") < ntz(RUN_START))
    content = [c for c in old.columns if c not in ("ordinal", "source", "external_id")]
    folded = old.groupBy("source", "external_id").agg(
        (F.min("ordinal") + 1).alias("id"),
        F.max_by(F.struct(*content), "ordinal").alias("c"),
        F.min("posted_at").alias("first_seen_at"),
        F.max("posted_at").alias("last_seen_at"),
    )
    missed = F.floor(F.datediff(ntz(RUN_START), F.col("last_seen_at")) / 400).cast("int")
    return folded.select(
        "id", "source", "external_id", "c.*", "first_seen_at", "last_seen_at",
        posting_status(F.col("source"), missed).alias("status"),
        missed.alias("missed_run_count"),
        F.when(F.col("c.salary_is_predicted"), F.lit(None)).otherwise(F.col("last_seen_at"))
        .alias("embedding_queued_at"),
    )


ORDER_SQL = f"""versions AS (
  SELECT o_orderkey AS ordinal, o_orderpriority AS source, CAST(o_custkey AS VARCHAR) AS external_id,
         'order ' || o_orderstatus AS title, 'customer ' || o_custkey AS company,
         'https://example.test/order/' || o_custkey AS url,
         o_orderpriority || ' ' || o_orderstatus AS description, o_orderdate AS posted_at,
         o_totalprice AS salary_min, o_orderstatus = 'P' AS predicted
  FROM orders),
batch AS (SELECT * FROM versions WHERE posted_at >= TIMESTAMP '{RUN_START}'),
folded AS (
  SELECT source, external_id, min(ordinal) + 1 AS id, arg_max(title, ordinal) AS title,
         arg_max(company, ordinal) AS company, arg_max(description, ordinal) AS description,
         arg_max(salary_min, ordinal) AS salary_min, arg_max(predicted, ordinal) AS predicted,
         min(posted_at) AS first_seen_at, max(posted_at) AS last_seen_at,
         CAST(floor(date_diff('day', max(posted_at), TIMESTAMP '{RUN_START}') / 400.0) AS INTEGER)
           AS missed_run_count
  FROM versions WHERE posted_at < TIMESTAMP '{RUN_START}' GROUP BY ALL),
store AS (
  SELECT *, CASE WHEN missed_run_count >= 3 THEN 'removed' WHEN missed_run_count >= 1 THEN 'stale'
                 ELSE 'active' END AS status,
         CASE WHEN predicted THEN NULL ELSE last_seen_at END AS embedding_queued_at
  FROM folded)"""


# --- events as an application log, lineitem as generated artifacts ----------------

STATUS_OF_EVENT = {
    "view": "saved", "click": "applied", "signup": "interviewing", "purchase": "offer",
    "error": "dismissed",
}


def status_log(spark: SparkSession, d: str) -> DataFrame:
    pairs = [F.lit(x) for kv in STATUS_OF_EVENT.items() for x in kv]
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("application_id"),
        F.element_at(F.create_map(*pairs), F.col("event_type")).alias("status"),
        F.col("props").alias("note"), F.col("ts").alias("created_at"), "value")


STATUS_LOG_SQL = """status_log AS (
  SELECT event_id AS id, user_id AS application_id,
         CASE event_type WHEN 'view' THEN 'saved' WHEN 'click' THEN 'applied'
              WHEN 'signup' THEN 'interviewing' WHEN 'purchase' THEN 'offer'
              WHEN 'error' THEN 'dismissed' END AS status,
         props AS note, ts AS created_at, value
  FROM events)"""


def row_count() -> Column:
    return F.count(F.lit(1)).alias("n")
