"""Upsert, miss counting, status and cleanup queries, mostly over orders as postings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import upsert as up
from ..operators.ordered import keep_first, keep_last
from ..sources.tables import backfill, scan_table
from .registry import query
from .tables import (
    APPLICATION_SQL, ORDER_SQL, POSTING_SQL, RUN_AT, RUN_SOURCE, application, ntz, order_batch,
    order_store, order_versions, posting, table,
)

# --- de-duplication ------------------------------------------------------------------

@query("dedupe_keep_first", """SELECT o_orderpriority AS source, CAST(o_custkey AS VARCHAR) AS external_id,
  min(o_orderkey) AS ordinal, arg_min(o_totalprice, o_orderkey) AS salary_min,
  arg_min(o_orderstatus, o_orderkey) AS state
FROM orders GROUP BY 1, 2""")
def _keep_first(spark, d):
    rows = keep_first(order_versions(spark, d), up.KEY, "ordinal")
    return rows.select(*up.KEY, "ordinal", "salary_min", F.element_at("tags", 1).alias("state"))


@query("dedupe_keep_last", """SELECT o_orderpriority AS source, CAST(o_custkey AS VARCHAR) AS external_id,
  max(o_orderkey) AS ordinal, arg_max(o_totalprice, o_orderkey) AS salary_min,
  arg_max(o_orderstatus, o_orderkey) AS state
FROM orders GROUP BY 1, 2""")
def _keep_last(spark, d):
    rows = keep_last(order_versions(spark, d), up.KEY, "ordinal")
    return rows.select(*up.KEY, "ordinal", "salary_min", F.element_at("tags", 1).alias("state"))


# --- upsert --------------------------------------------------------------------------

def _upserted(spark, d, missing=RUN_SOURCE):
    return up.upsert_postings(order_store(spark, d), order_batch(spark, d), ntz(RUN_AT), missing)


def upsert_sql(missing: str = RUN_SOURCE) -> str:
    return f"""WITH {ORDER_SQL},
fresh AS (
  SELECT source, external_id, arg_max(title, ordinal) AS title, arg_max(company, ordinal) AS company,
         arg_max(description, ordinal) AS description, arg_max(salary_min, ordinal) AS salary_min,
         min(ordinal) AS first_ordinal, count(*) AS copies, count(DISTINCT title || description) AS texts
  FROM batch GROUP BY ALL),
top AS (SELECT coalesce(max(id), 0) AS m FROM store),
joined AS (
  SELECT coalesce(s.source, f.source) AS source, coalesce(s.external_id, f.external_id) AS external_id,
         s.id AS old_id, f.copies IS NOT NULL AS seen, s.id IS NULL AS is_new,
         f.copies IS NULL AND s.source = '{missing}' AS gone,
         s.title AS s_title, s.company AS s_company, s.description AS s_description,
         s.salary_min AS s_salary, s.first_seen_at AS s_first, s.last_seen_at AS s_last,
         s.status AS s_status, s.missed_run_count AS s_missed, s.embedding_queued_at,
         f.title AS f_title, f.company AS f_company, f.description AS f_description,
         f.salary_min AS f_salary, f.first_ordinal, f.copies, f.texts
  FROM store s FULL OUTER JOIN fresh f ON s.source = f.source AND s.external_id = f.external_id),
counted AS (
  SELECT *, CASE WHEN seen THEN 0 WHEN gone THEN s_missed + 1 ELSE s_missed END AS missed FROM joined),
result AS (
  SELECT coalesce(old_id, m + first_ordinal + 1) AS id, source, external_id,
    CASE WHEN seen THEN f_title ELSE s_title END AS title,
    CASE WHEN seen THEN f_company ELSE s_company END AS company,
    CASE WHEN seen THEN f_description ELSE s_description END AS description,
    CASE WHEN seen THEN f_salary ELSE s_salary END AS salary_min,
    coalesce(s_first, TIMESTAMP '{RUN_AT}') AS first_seen_at,
    CASE WHEN seen THEN TIMESTAMP '{RUN_AT}' ELSE s_last END AS last_seen_at,
    CASE WHEN seen THEN 'active' WHEN NOT gone THEN s_status
         WHEN missed >= 3 THEN 'removed' WHEN missed >= 1 THEN 'stale' ELSE 'active' END AS status,
    CAST(missed AS INTEGER) AS missed_run_count, embedding_queued_at, is_new,
    CAST(coalesce(copies - CAST(is_new AS INTEGER), 0) AS BIGINT) AS update_rows,
    seen AND (is_new OR s_title <> f_title OR s_description <> f_description OR texts > 1
              OR embedding_queued_at IS NULL) AS to_embed,
    gone AND missed >= 3 AND s_status <> 'removed' AS newly_removed
  FROM counted, top)"""


@query("upsert_postings", f"{upsert_sql()} SELECT * FROM result")
def upsert_query(spark, d):
    return _upserted(spark, d).select(
        "id", "source", "external_id", "title", "company", "description", "salary_min",
        "first_seen_at", "last_seen_at", "status", "missed_run_count", "embedding_queued_at",
        *up.FLAGS)


@query("join_upsert", f"""{upsert_sql()}
SELECT source, count(*) FILTER (WHERE is_new) AS inserted,
       count(*) FILTER (WHERE NOT is_new AND update_rows > 0) AS refreshed,
       count(*) FILTER (WHERE update_rows = 0 AND NOT is_new) AS untouched FROM result GROUP BY source""")
def _join_upsert(spark, d):
    """The three kinds of rows the full outer join yields, per source."""
    return _upserted(spark, d).groupBy("source").agg(
        F.count_if("is_new").alias("inserted"),
        F.count_if(~F.col("is_new") & (F.col("update_rows") > 0)).alias("refreshed"),
        F.count_if(~F.col("is_new") & (F.col("update_rows") == 0)).alias("untouched"))


COUNTS = """SELECT count(*) FILTER (WHERE is_new) AS new_count, CAST(sum(update_rows) AS BIGINT) AS updated_count,
  count(*) FILTER (WHERE to_embed) AS to_embed_count,
  count(*) FILTER (WHERE newly_removed) AS newly_removed_count FROM result"""


@query("upsert_counts", f"{upsert_sql()} {COUNTS}")
def _upsert_counts(spark, d):
    return up.upsert_counts(_upserted(spark, d))


@query("concat_to_embed", f"{upsert_sql()} SELECT id, source FROM result WHERE to_embed")
def _to_embed(spark, d):
    """new ∪ changed ∪ never confirmed, each id once."""
    return _upserted(spark, d).filter("to_embed").select("id", "source")


@query("mark_queued", f"""{upsert_sql()}, confirmed AS (SELECT id FROM result WHERE to_embed AND status = 'active'
  AND source <> '2-HIGH')
SELECT r.id, CASE WHEN c.id IS NOT NULL THEN TIMESTAMP '{RUN_AT}' ELSE r.embedding_queued_at END
  AS embedding_queued_at FROM result r LEFT JOIN confirmed c ON c.id = r.id""")
def _mark_queued(spark, d):
    """One source's queue did not confirm: those rows keep their old stamp."""
    result = _upserted(spark, d)
    confirmed = result.filter("to_embed and source <> '2-HIGH'").select(F.col("id").alias("vacancy_id"))
    return up.mark_queued(up.snapshot(result), confirmed, ntz(RUN_AT)).select("id", "embedding_queued_at")


@query("difference_confirmed", f"""{upsert_sql()}
SELECT id FROM result WHERE to_embed AND source = '2-HIGH'""")
def _difference_confirmed(spark, d):
    wanted = _upserted(spark, d).filter("to_embed").select("id", "source")
    confirmed = wanted.filter("source <> '2-HIGH'").select("id")
    return wanted.select("id").join(confirmed, "id", "left_anti")


@query("anti_join_missing", f"""WITH {ORDER_SQL}
SELECT id, external_id FROM store WHERE source = '{RUN_SOURCE}' AND external_id NOT IN
  (SELECT external_id FROM batch WHERE source = '{RUN_SOURCE}')""")
def _anti_join_missing(spark, d):
    seen = order_batch(spark, d).filter(F.col("source") == RUN_SOURCE)
    return up.anti_join_missing(order_store(spark, d), RUN_SOURCE, seen).select("id", "external_id")


MISSING_SQL = f"""WITH {ORDER_SQL},
marked AS (
  SELECT s.*, s.source = '{RUN_SOURCE}' AND s.external_id NOT IN
    (SELECT external_id FROM batch WHERE source = '{RUN_SOURCE}') AS gone FROM store s),
result AS (
  SELECT id, source, missed_run_count + CAST(gone AS INTEGER) AS missed_run_count,
    CASE WHEN NOT gone THEN status WHEN missed_run_count >= 2 THEN 'removed' ELSE 'stale' END AS new_status,
    gone AND missed_run_count >= 2 AND status <> 'removed' AS newly_removed
  FROM marked)"""


def _mark_missing(spark, d):
    seen = order_batch(spark, d).filter(F.col("source") == RUN_SOURCE)
    return up.mark_missing(order_store(spark, d), RUN_SOURCE, seen)


@query("mark_missing", f"""{MISSING_SQL}
SELECT id, source, missed_run_count, new_status AS status, newly_removed FROM result""")
def _mark_missing_query(spark, d):
    return _mark_missing(spark, d).select("id", "source", "missed_run_count", "status", "newly_removed")


@query("newly_removed_count", f"{MISSING_SQL} SELECT count(*) FILTER (WHERE newly_removed) AS n FROM result")
def _newly_removed(spark, d):
    return _mark_missing(spark, d).agg(F.count_if("newly_removed").alias("n"))


@query("posting_status", f"""WITH {ORDER_SQL}
SELECT source, status, missed_run_count, count(*) AS n FROM store GROUP BY ALL""")
def _posting_status(spark, d):
    return order_store(spark, d).groupBy("source", "status", "missed_run_count").agg(
        F.count(F.lit(1)).alias("n"))


# --- thresholds and streaks --------------------------------------------------------------

@query("join_thresholds", """
WITH limits AS (SELECT o_orderpriority AS source, CAST(count(DISTINCT o_custkey) / 100 AS INTEGER) AS stale_after,
                       CAST(count(DISTINCT o_custkey) / 50 AS INTEGER) AS removed_after
                FROM orders WHERE o_orderpriority LIKE '%H%' GROUP BY 1)
SELECT o_orderkey, coalesce(stale_after, 1) AS stale_after, coalesce(removed_after, 3) AS removed_after
FROM orders LEFT JOIN limits ON source = o_orderpriority""")
def _join_thresholds(spark, d):
    """Thresholds from a table that does not name every source."""
    orders = table(spark, d, "orders")
    customers = F.countDistinct("o_custkey")
    limits = orders.filter(F.col("o_orderpriority").contains("H")).groupBy(
        F.col("o_orderpriority").alias("source")
    ).agg(F.rint(customers / 100).cast("int").alias("stale_after"),
          F.rint(customers / 50).cast("int").alias("removed_after"))
    rows = orders.select("o_orderkey", F.col("o_orderpriority").alias("source"))
    return up.join_thresholds(rows, limits).select("o_orderkey", "stale_after", "removed_after")


DAY_SQL = "date_diff('day', TIMESTAMP '2024-01-01', ts)"


@query("missed_run_streak", f"""
WITH seen AS (SELECT event_type AS source, user_id AS external_id, {DAY_SQL} AS run FROM events),
runs AS (SELECT source, run, count(*) AS n FROM seen GROUP BY ALL),
good AS (SELECT source, run FROM runs QUALIFY n * 10 * count(*) OVER (PARTITION BY source)
         >= 9 * sum(n) OVER (PARTITION BY source)),
numbered AS (SELECT source, run, row_number() OVER (PARTITION BY source ORDER BY run) AS run_no FROM good),
last_seen AS (SELECT s.source, s.external_id, max(s.run) AS run FROM seen s SEMI JOIN good g
              ON g.source = s.source AND g.run = s.run GROUP BY ALL)
SELECT l.source, l.external_id,
       (SELECT max(run_no) FROM numbered m WHERE m.source = l.source) - n.run_no AS missed_run_count
FROM last_seen l JOIN numbered n ON n.source = l.source AND n.run = l.run""")
def _missed_run_streak(spark, d):
    """Runs are days of an event type; a day that stays a tenth below the type's mean failed."""
    day = F.datediff("ts", ntz("2024-01-01 00:00:00"))
    seen = table(spark, d, "events").select(
        F.col("event_type").alias("source"), F.col("user_id").alias("external_id"), day.alias("run"))
    runs = seen.groupBy("source", "run").agg(F.count(F.lit(1)).alias("n"))
    usual = runs.groupBy("source").agg(F.count(F.lit(1)).alias("days"), F.sum("n").alias("all"))
    good = runs.join(usual, "source").filter("n * 10 * days >= 9 * all").select("source", "run")
    return up.missed_run_streak(good, seen)


# --- cleanup -------------------------------------------------------------------------------

CLEAN_AT = "2024-04-10 00:00:00"
ARTIFACT_SQL = "artifact AS (SELECT conv_id AS vacancy_id FROM conversations)"


def _clean(spark, d):
    rows = posting(spark, d).withColumn("first_seen_at", F.col("last_seen_at"))
    artifact = table(spark, d, "conversations").select(F.col("conv_id").alias("vacancy_id"))
    return rows, application(spark, d), artifact


CLEAN_SQL = f"""WITH {POSTING_SQL}, {APPLICATION_SQL}, {ARTIFACT_SQL},
history AS (SELECT vacancy_id FROM application UNION SELECT vacancy_id FROM artifact),
candidates AS (
  SELECT id, source, company, id NOT IN (SELECT vacancy_id FROM history) AS deletable FROM posting
  WHERE status = 'removed' AND last_seen_at < TIMESTAMP '{CLEAN_AT}' - INTERVAL 90 DAY)"""


@query("cleanup_candidates", f"{CLEAN_SQL} SELECT id, source, company, deletable FROM candidates")
def _cleanup_candidates(spark, d):
    return up.cleanup_candidates(*_clean(spark, d), ntz(CLEAN_AT)).select(
        "id", "source", "company", "deletable")


@query("semi_anti_history", f"""{CLEAN_SQL}
SELECT CASE WHEN deletable THEN 'without history' ELSE 'with history' END AS kind, count(*) AS n,
       min(id) AS lowest FROM candidates GROUP BY 1""")
def _semi_anti_history(spark, d):
    rows, app, art = _clean(spark, d)
    old = up.cleanup_candidates(rows, app, art, ntz(CLEAN_AT)).drop("deletable")
    history = up.distinct_history_ids(app, art).withColumnRenamed("vacancy_id", "id")

    def part(kind, how):
        return old.join(history, "id", how).select(F.lit(kind).alias("kind"), "id")

    both = part("with history", "left_semi").union(part("without history", "left_anti"))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lowest"))


@query("cleanup_summary", f"""{CLEAN_SQL} SELECT count(*) AS candidates,
  count(*) FILTER (WHERE deletable) AS to_delete, count(*) FILTER (WHERE NOT deletable) AS kept_for_history
FROM candidates""")
def _cleanup_summary(spark, d):
    return up.cleanup_summary(up.cleanup_candidates(*_clean(spark, d), ntz(CLEAN_AT)))


@query("distinct_history_ids", f"""WITH {APPLICATION_SQL}, {ARTIFACT_SQL}
SELECT vacancy_id FROM application UNION SELECT vacancy_id FROM artifact""")
def _distinct_history_ids(spark, d):
    _, app, art = _clean(spark, d)
    return up.distinct_history_ids(app, art)


@query("union_history", """SELECT count(*) AS n FROM (
  SELECT o_custkey AS id FROM orders UNION SELECT user_id FROM events)""")
def _union_history(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("vacancy_id"))
    events = table(spark, d, "events").select(F.col("user_id").alias("vacancy_id"))
    return up.distinct_history_ids(orders, events).agg(F.count(F.lit(1)).alias("n"))


def _deleted(spark, d):
    rows, app, art = _clean(spark, d)
    index = table(spark, d, "embeddings").select(F.col("vec_id").alias("vacancy_id"), "label")
    return up.delete_postings(rows, index, up.cleanup_candidates(rows, app, art, ntz(CLEAN_AT)))


@query("delete_postings", f"""{CLEAN_SQL} SELECT id, source FROM posting
WHERE id NOT IN (SELECT id FROM candidates WHERE deletable)""")
def _delete_postings(spark, d):
    return _deleted(spark, d)[0].select("id", "source")


@query("delete_index", f"""{CLEAN_SQL} SELECT vec_id AS vacancy_id, label FROM embeddings
WHERE vec_id NOT IN (SELECT id FROM candidates WHERE deletable)""")
def _delete_index(spark, d):
    return _deleted(spark, d)[1]


@query("backfill", f"""SELECT doc_id AS vacancy_id, TIMESTAMP '{RUN_AT}' AS published_at FROM documents""")
def _backfill(spark, d):
    return backfill(posting(spark, d), ntz(RUN_AT))


@query("scan_table", """SELECT l_orderkey, l_quantity FROM lineitem
WHERE l_shipdate >= TIMESTAMP '2000-01-01' AND l_returnflag = 'R'""")
def _scan_table(spark, d):
    """Filter and column list reach the Parquet scan."""
    path = f"{d.rstrip('/')}/lineitem.parquet"
    rows = scan_table(spark, path, "l_orderkey", "l_quantity", "l_shipdate", "l_returnflag")
    return rows.filter(
        (F.col("l_shipdate") >= ntz("2000-01-01 00:00:00")) & (F.col("l_returnflag") == "R")
    ).select("l_orderkey", "l_quantity")
