"""Transition log, application state, artifacts, pipeline, runs and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import APPLICATION_STATUSES, ARTIFACT_TYPES
from ..operators import filters as fl
from ..operators import tracking as tr
from ..operators.ordered import carry_forward
from ..sources.profile import append_resume_version, count_children, list_children, replace_profile
from .registry import query
from .tables import (
    APPLICATION_SQL, POSTING_SQL, RUN_AT, STATUS_LOG_SQL, application, ntz, posting, row_count,
    status_log, table,
)
from .text import PROFILE_SQL, profiles



@query("current_status", f"""WITH {STATUS_LOG_SQL}
SELECT application_id, arg_max(status, id) AS status FROM status_log GROUP BY 1""")
def _current_status(spark, d):
    return tr.current_status(status_log(spark, d))


TRANSITIONS = f"""WITH {STATUS_LOG_SQL},
transitions AS (SELECT *, lag(status) OVER (PARTITION BY application_id ORDER BY id) AS previous_status
                FROM status_log QUALIFY previous_status IS DISTINCT FROM status)"""


@query("status_transitions", f"{TRANSITIONS} SELECT id, application_id, status, previous_status FROM transitions")
def _status_transitions(spark, d):
    """Chunks of 1000 ids here, so the carry between chunks is at work."""
    return tr.status_transitions(status_log(spark, d), width=1000).select(
        "id", "application_id", "status", "previous_status")


# Updates: some name the notes, some the follow-up date, some clear them.
UPDATE_SQL = f"""{STATUS_LOG_SQL},
updates AS (
  SELECT id, application_id AS vacancy_id, status, created_at,
         status IN ('saved', 'applied') AS notes_set,
         CASE WHEN value < 10 THEN '' ELSE note END AS notes,
         status = 'interviewing' AS follow_up_set,
         CASE WHEN value < 100 THEN CAST(created_at AS DATE) END AS follow_up_at
  FROM status_log)"""


def updates(spark, d):
    return status_log(spark, d).select(
        "id", F.col("application_id").alias("vacancy_id"), "status", "created_at",
        F.col("status").isin("saved", "applied").alias("notes_set"),
        F.when(F.col("value") < 10, F.lit("")).otherwise(F.col("note")).alias("notes"),
        (F.col("status") == "interviewing").alias("follow_up_set"),
        F.when(F.col("value") < 100, F.col("created_at").cast("date")).alias("follow_up_at"))


@query("partial_update", f"""WITH {UPDATE_SQL}
SELECT vacancy_id, arg_max(status, id) AS status,
       coalesce((max({{'i': id, 'v': notes}}) FILTER (WHERE notes_set)).v, '') AS notes,
       (max({{'i': id, 'v': follow_up_at}}) FILTER (WHERE follow_up_set)).v AS follow_up_at,
       min(created_at) AS created_at, max(created_at) AS updated_at
FROM updates GROUP BY vacancy_id""")
def _partial_update(spark, d):
    return tr.fold_updates(updates(spark, d))


@query("partial_update_history", f"""WITH {UPDATE_SQL}
SELECT id, vacancy_id, (max(CASE WHEN follow_up_set THEN {{'i': id, 'v': follow_up_at}} END)
       OVER (PARTITION BY vacancy_id ORDER BY id)).v AS follow_up_at
FROM updates""")
def _partial_update_history(spark, d):
    """The follow-up date after every single update."""
    rows = updates(spark, d).withColumnRenamed("follow_up_at", "given")
    return carry_forward(
        rows, ["vacancy_id"], "id", F.col("given"), F.col("follow_up_set"), "follow_up_at", width=1000
    ).select("id", "vacancy_id", "follow_up_at")


@query("append_events", f"""WITH {UPDATE_SQL},
changes AS (SELECT *, lag(status) OVER (PARTITION BY vacancy_id ORDER BY id) AS previous FROM updates
            QUALIFY previous IS DISTINCT FROM status)
SELECT id, vacancy_id, status, CASE WHEN notes_set THEN coalesce(notes, '') ELSE '' END AS note, created_at
FROM changes""")
def _append_events(spark, d):
    return tr.append_events(updates(spark, d))


@query("validate_enum", """SELECT event_type, count(*) AS n FROM events
WHERE event_type NOT IN ('view', 'click', 'purchase') GROUP BY 1""")
def _validate_enum(spark, d):
    """The quarantine side: event types outside an allowed list."""
    _, bad = fl.validate_enum(table(spark, d, "events"), "event_type", ("view", "click", "purchase"))
    return bad.groupBy("event_type").agg(row_count())


# --- artifacts ---------------------------------------------------------------------------

GENERATED_SQL = """generated AS (
  SELECT conv_id * 1000 + turn AS id, conv_id AS vacancy_id,
         CASE role WHEN 'assistant' THEN 'cover_letter' WHEN 'user' THEN 'tailoring_suggestions'
                   ELSE role END AS artifact_type, text AS content
  FROM conversations)"""


def generated(spark, d):
    kind = (
        F.when(F.col("role") == "assistant", F.lit("cover_letter"))
        .when(F.col("role") == "user", F.lit("tailoring_suggestions")).otherwise(F.col("role")))
    return table(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("vacancy_id"),
        kind.alias("artifact_type"), F.col("text").alias("content"))


ARTIFACT_SQL = f"""{POSTING_SQL}, {GENERATED_SQL},
artifact AS (
  SELECT g.id, g.vacancy_id, g.artifact_type, g.content, p.title AS vacancy_title,
         p.company AS vacancy_company, p.url AS vacancy_url, TIMESTAMP '{RUN_AT}' AS created_at
  FROM generated g JOIN posting p ON p.id = g.vacancy_id
  WHERE g.artifact_type IN ('cover_letter', 'tailoring_suggestions'))"""


def artifacts(spark, d):
    return tr.append_artifact(generated(spark, d), posting(spark, d), ntz(RUN_AT))


@query("append_artifact", f"""WITH {ARTIFACT_SQL}
SELECT id, vacancy_id, artifact_type, md5(content) AS content_md5, md5(vacancy_title) AS title_md5,
       vacancy_company, vacancy_url, created_at FROM artifact""")
def _append_artifact(spark, d):
    return artifacts(spark, d).select(
        "id", "vacancy_id", "artifact_type", F.md5("content").alias("content_md5"),
        F.md5("vacancy_title").alias("title_md5"), "vacancy_company", "vacancy_url", "created_at")


@query("artifact_quarantine", f"""WITH {GENERATED_SQL} SELECT id, artifact_type FROM generated
WHERE artifact_type NOT IN ('cover_letter', 'tailoring_suggestions')""")
def _artifact_quarantine(spark, d):
    _, bad = fl.validate_enum(generated(spark, d), "artifact_type", ARTIFACT_TYPES)
    return bad.select("id", "artifact_type")


@query("project_artifact_summary", f"WITH {ARTIFACT_SQL} SELECT id, vacancy_id, artifact_type, created_at FROM artifact")
def _artifact_summary(spark, d):
    return tr.artifact_summary(artifacts(spark, d))


# Events stand in for a long artifact table: one user holds many rows.
NESTED_SQL = """nested AS (
  SELECT user_id AS vacancy_id, count(*) AS n, max(event_id) AS newest FROM events GROUP BY 1)"""


def event_artifacts(spark, d):
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("vacancy_id"),
        F.col("event_type").alias("artifact_type"), F.col("props").alias("content"),
        F.col("ts").alias("created_at"))


@query("artifacts_by_posting", f"WITH {NESTED_SQL} SELECT vacancy_id, n, newest FROM nested")
def _artifacts_by_posting(spark, d):
    return tr.artifacts_by_posting(event_artifacts(spark, d)).select(
        "vacancy_id", F.col("n_artifacts").alias("n"), F.col("newest_id").alias("newest"))


@query("artifact_list", """SELECT user_id AS vacancy_id, event_id AS id, event_type AS artifact_type,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1 AS position FROM events""")
def _artifact_list(spark, d):
    return tr.artifact_list(event_artifacts(spark, d)).select(
        "vacancy_id", "id", "artifact_type", "position")


@query("join_pipeline", f"""WITH {POSTING_SQL}, {APPLICATION_SQL}, {NESTED_SQL}
SELECT a.vacancy_id, a.status, p.company, coalesce(n.n, 0) AS n_artifacts, n.newest
FROM application a JOIN posting p ON p.id = a.vacancy_id LEFT JOIN nested n ON n.vacancy_id = a.vacancy_id""")
def _join_pipeline(spark, d):
    state = application(spark, d).withColumns({
        "notes": F.lit(""), "follow_up_at": F.lit(None).cast("date"),
        "updated_at": F.lit(None).cast("timestamp")})
    return tr.join_pipeline(posting(spark, d), state, event_artifacts(spark, d)).select(
        "vacancy_id", "status", "company", "n_artifacts", F.col("newest_id").alias("newest"))


ENUM_SQL = "[" + ", ".join(f"'{s}'" for s in APPLICATION_STATUSES) + "]"


@query("pipeline_counts", f"""WITH {POSTING_SQL}, {APPLICATION_SQL}
SELECT status, count(*) AS n, list_position({ENUM_SQL}, status) AS position
FROM application SEMI JOIN posting ON posting.id = application.vacancy_id GROUP BY ROLLUP (status)""")
def _pipeline_counts(spark, d):
    rows = tr.pipeline_counts(application(spark, d), posting(spark, d))
    return rows.select("status", "n", F.col("position").cast("int").alias("position"))


@query("top_recent", "SELECT event_id AS id, event_type FROM events ORDER BY event_id DESC LIMIT 25")
def _top_recent(spark, d):
    return fl.top_recent(
        table(spark, d, "events").select(F.col("event_id").alias("id"), "event_type"), 25)


# --- run log -------------------------------------------------------------------------------

RUNS_SQL = """starts AS (
  SELECT o_orderkey AS run_id, o_orderpriority AS source, o_orderdate AS started_at FROM orders),
finishes AS (
  SELECT l_orderkey AS run_id, l_linenumber AS seq, max(l_shipdate) AS finished_at,
         CAST(sum(l_quantity) AS INTEGER) AS fetched_count, CAST(count(*) AS INTEGER) AS new_count,
         max(l_linenumber) AS updated_count,
         CASE WHEN bool_or(l_returnflag = 'R') THEN rpad('returned ', 2500, 'x') END AS error
  FROM lineitem GROUP BY ALL),
runs AS (
  SELECT s.*, f.finished_at, f.fetched_count, f.new_count, f.updated_count, left(f.error, 2000) AS error,
         CASE WHEN f.finished_at IS NULL THEN 'running' WHEN f.error IS NOT NULL THEN 'failed' ELSE 'ok' END
           AS state
  FROM starts s LEFT JOIN (SELECT * FROM finishes QUALIFY
    row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) = 1) f USING (run_id))"""


def run_rows(spark, d):
    starts = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("source"),
        F.col("o_orderdate").alias("started_at"))
    starts, lines = tr.by_run(starts, table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_returnflag"), "l_orderkey")
    finishes = lines.groupBy(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("seq")
    ).agg(
        F.max("l_shipdate").alias("finished_at"),
        F.sum("l_quantity").cast("int").alias("fetched_count"),
        F.count(F.lit(1)).cast("int").alias("new_count"),
        F.max("l_linenumber").alias("updated_count"),
        F.when(F.bool_or(F.col("l_returnflag") == "R"), F.rpad(F.lit("returned "), 2500, "x"))
        .alias("error"))
    return starts, finishes


@query("run_log", f"""WITH {RUNS_SQL}
SELECT run_id, source, started_at, finished_at, fetched_count, new_count, length(error) AS error_length, state
FROM runs""")
def _run_log(spark, d):
    return tr.run_log(*run_rows(spark, d)).select(
        "run_id", "source", "started_at", "finished_at", "fetched_count", "new_count",
        F.length("error").cast("bigint").alias("error_length"), "state")


@query("run_log_start", f"""WITH {RUNS_SQL} SELECT source, count(*) FILTER (WHERE state = 'running') AS open_runs,
  count(*) AS n FROM runs GROUP BY source""")
def _run_log_start(spark, d):
    """Started rows without a finish are the open runs."""
    return tr.run_log(*run_rows(spark, d)).groupBy("source").agg(
        F.count_if(F.col("state") == "running").alias("open_runs"), row_count())


@query("run_log_finish", f"""WITH {RUNS_SQL}
SELECT run_id, seq FROM finishes WHERE run_id NOT IN (SELECT run_id FROM starts WHERE source <> '5-LOW')""")
def _run_log_finish(spark, d):
    """Finish rows whose run never started: here the starts of one source were lost."""
    starts, finishes = run_rows(spark, d)
    return tr.unknown_finishes(starts.filter("source <> '5-LOW'"), finishes).select("run_id", "seq")


@query("filter_runs", f"""WITH {RUNS_SQL} SELECT run_id AS id, source, state FROM runs WHERE source = '2-HIGH'
ORDER BY run_id DESC LIMIT 50""")
def _filter_runs(spark, d):
    return tr.newest_runs(*run_rows(spark, d), "2-HIGH", 50).select("id", "source", "state")


# --- profiles --------------------------------------------------------------------------------

@query("append_resume_version", f"""WITH {PROFILE_SQL}
SELECT id AS profile_id, 'spring' AS label, full_name, company, TIMESTAMP '{RUN_AT}' AS created_at FROM profile""")
def _append_resume_version(spark, d):
    rows = append_resume_version(profiles(spark, d)[0], "spring", ntz(RUN_AT))
    return rows.select(
        "profile_id", "label", F.get_json_object("content", "$.full_name").alias("full_name"),
        F.get_json_object("content", "$.experiences[0].company").alias("company"), "created_at")


@query("replace_profile", f"""WITH {PROFILE_SQL}
SELECT id, CASE WHEN company = 'Nation 3' THEN 'moved' ELSE summary END AS summary,
       CASE WHEN company = 'Nation 3' THEN 0 ELSE 1 END AS n_experiences FROM profile""")
def _replace_profile(spark, d):
    """Profiles of one nation come back with another summary and no experience."""
    stored = profiles(spark, d)[0]
    fresh = stored.filter(F.col("experiences")[0]["company"] == "Nation 3").withColumn(
        "summary", F.lit("moved")).withColumn("experiences", F.slice("experiences", 1, 0))
    return replace_profile(stored, fresh).select(
        "id", "summary", F.size("experiences").alias("n_experiences"))


def _children(spark, d):
    skills = table(spark, d, "orders").select(
        F.col("o_custkey").alias("profile_id"), F.col("o_orderkey").alias("id"), "o_orderpriority")
    jobs = table(spark, d, "events").select(
        F.col("user_id").alias("profile_id"), F.col("event_id").alias("id"), "event_type")
    return {"skills": (skills, F.col("o_orderpriority")), "experiences": (jobs, F.col("event_type"))}


@query("nest_profile_children", """
SELECT o_custkey AS profile_id, 'skills' AS child, o_orderpriority AS item,
       row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS position FROM orders
UNION ALL
SELECT user_id, 'experiences', event_type,
       row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 FROM events""")
def _nest_profile_children(spark, d):
    return list_children(_children(spark, d))


@query("project_profile", """SELECT c_custkey AS profile_id, c_name,
  (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_skills,
  (SELECT count(*) FROM events WHERE user_id = c_custkey) AS n_experiences FROM customer""")
def _project_profile(spark, d):
    profile = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    return count_children(profile, {n: t for n, (t, _) in _children(spark, d).items()})
