"""Applications: transition log, current state, artifacts, pipeline, run log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import APPLICATION_STATUSES, ARTIFACT_TYPES, ERROR_TEXT_LIMIT
from ..functions.text import truncate
from .filters import check_run_limit, run_state, validate_enum
from .ordered import CHUNK_ROWS, number_rows, with_previous

#: Runs per task of a run log: with each error at its limit, a few hundred MB.
RUNS_PER_TASK = 50_000


def status_order(status: Column) -> Column:
    """Position of a status in the enum (1-based)."""
    return F.array_position(F.array(*[F.lit(s) for s in APPLICATION_STATUSES]), status)


def current_status(log: DataFrame, key: str = "application_id", order: str = "id") -> DataFrame:
    """Last status per key by log id, not by time."""
    return log.groupBy(key).agg(F.max_by("status", order).alias("status"))


def status_transitions(
    log: DataFrame, key: str = "application_id", order: str = "id", width: int = CHUNK_ROWS,
) -> DataFrame:
    """Rows whose status differs from the preceding one of the same key."""
    return (
        with_previous(log, [key], order, F.col("status"), "previous_status", width)
        .filter(~F.col("status").eqNullSafe(F.col("previous_status")))
    )


def fold_updates(log: DataFrame, key: str = "vacancy_id", order: str = "id") -> DataFrame:
    """Application state after all updates: ``(key, status, notes, follow_up_at, created_at, updated_at)``.

    ``notes_set`` / ``follow_up_set`` say whether an update names the field. An unset
    field keeps its value, an explicit empty string or NULL clears it - hence the
    box around the value.
    """
    def latest(value: str, is_set: str) -> Column:
        chosen = F.max_by(F.struct(F.col(value).alias("v")), F.when(F.col(is_set), F.col(order)))
        return chosen["v"]

    return log.groupBy(key).agg(
        F.max_by("status", order).alias("status"),
        F.coalesce(latest("notes", "notes_set"), F.lit("")).alias("notes"),
        latest("follow_up_at", "follow_up_set").alias("follow_up_at"),
        F.min_by("created_at", order).alias("created_at"),
        F.max_by("created_at", order).alias("updated_at"),
    )


def append_events(updates: DataFrame, key: str = "vacancy_id", order: str = "id") -> DataFrame:
    """The rows an update log adds to the transition log: valid and real changes only."""
    valid, _ = validate_enum(updates, "status", APPLICATION_STATUSES)
    note = F.when(F.col("notes_set"), F.coalesce("notes", F.lit(""))).otherwise(F.lit(""))
    return status_transitions(valid, key, order).select(
        order, key, "status", note.alias("note"), "created_at")


def append_artifact(generated: DataFrame, posting: DataFrame, as_of: Column) -> DataFrame:
    """Artifact rows with a copy of the posting's title, company and URL.

    The copy is what makes an artifact independent of later edits of the posting.
    """
    valid, _ = validate_enum(generated, "artifact_type", ARTIFACT_TYPES)
    card = posting.select(
        F.col("id").alias("vacancy_id"), F.col("title").alias("vacancy_title"),
        F.col("company").alias("vacancy_company"), F.col("url").alias("vacancy_url"))
    return valid.join(card, "vacancy_id").select(
        "id", "vacancy_id", "artifact_type", "content", "vacancy_title", "vacancy_company",
        "vacancy_url", as_of.alias("created_at"))


def artifact_summary(artifact: DataFrame) -> DataFrame:
    """Everything but the text; the scan never reads ``content``."""
    return artifact.select("id", "vacancy_id", "artifact_type", "created_at")


def artifacts_by_posting(artifact: DataFrame) -> DataFrame:
    """One row per posting: ``vacancy_id, n_artifacts, newest_id``, however many it has."""
    return artifact.groupBy("vacancy_id").agg(
        F.count(F.lit(1)).alias("n_artifacts"), F.max("id").alias("newest_id"))


def artifact_list(artifact: DataFrame, width: int = CHUNK_ROWS) -> DataFrame:
    """Summaries with their ``position`` within the posting, newest first."""
    return number_rows(
        artifact_summary(artifact), ["vacancy_id"], "id", descending=True, width=width)


def join_posting_application(posting: DataFrame, application: DataFrame) -> DataFrame:
    """Inner join; Spark picks the strategy from the sizes."""
    return posting.join(
        application.withColumnRenamed("id", "application_id")
        .withColumnRenamed("status", "application_status"),
        F.col("vacancy_id") == F.col("id"))


def join_pipeline(posting: DataFrame, application: DataFrame, artifact: DataFrame) -> DataFrame:
    """Tracked postings, one row each, with count and newest id of their artifacts.

    Applications without a posting vanish; ``artifact_list`` holds the artifacts themselves.
    """
    card = posting.select(F.col("id").alias("vacancy_id"), "title", "company", "url")
    state = application.select("vacancy_id", "status", "notes", "follow_up_at", "updated_at")
    return (
        state.join(card, "vacancy_id")
        .join(artifacts_by_posting(artifact), "vacancy_id", "left")
        .withColumn("n_artifacts", F.coalesce("n_artifacts", F.lit(0)))
        .withColumn("status_order", status_order(F.col("status")))
    )


def pipeline_counts(application: DataFrame, posting: DataFrame) -> DataFrame:
    """Tracked postings per status in enum order, plus the total (status NULL)."""
    live = application.join(posting.select(F.col("id").alias("vacancy_id")), "vacancy_id", "left_semi")
    return (
        live.rollup("status").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("position", status_order(F.col("status")))
        .orderBy(F.col("position").asc_nulls_last())
    )


def by_run(starts: DataFrame, rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Start rows and rows of their finishes, dealt alike to tasks of about ``RUNS_PER_TASK`` runs.

    Spark sizes its partitions by compressed bytes, and error texts that are alike unpack to a
    hundred times theirs. The number of tasks follows the runs instead; deal rows before they
    get their texts, then ``run_log`` moves no text at all.
    """
    parts = max(1, -(-starts.count() // RUNS_PER_TASK))
    return starts.repartition(parts, "run_id"), rows.repartition(parts, key)


def run_log(starts: DataFrame, finishes: DataFrame) -> DataFrame:
    """Run view from append-only start and finish rows; the last finish row counts.

    ``finishes`` carries ``seq``, the order its rows were appended in. A run without
    a finish row is still open. Long logs come dealt by run (``by_run``).
    """
    short = finishes.withColumn("error", truncate(F.col("error"), ERROR_TEXT_LIMIT))
    last = short.groupBy("run_id").agg(F.max_by(F.struct(
        "finished_at", "fetched_count", "new_count", "updated_count", "error"), "seq").alias("f"))
    return (
        starts.join(last, "run_id", "left")
        .select(
            *starts.columns, "f.finished_at", "f.fetched_count", "f.new_count", "f.updated_count",
            "f.error")
        .withColumn("state", run_state(F.col("finished_at"), F.col("error")))
    )


def newest_runs(
    starts: DataFrame, finishes: DataFrame, source: str | None = None, limit: int = 50,
) -> DataFrame:
    """``filter_runs`` straight from the logs: the newest starts first, then their finish rows.

    The limit cuts the start rows, so the finish log is only looked up, never aggregated whole.
    """
    check_run_limit(limit)
    kept = starts.filter(F.col("source") == source) if source else starts
    newest = kept.orderBy(F.col("run_id").desc()).limit(limit)
    ended = finishes.join(newest.select("run_id"), "run_id", "left_semi")
    return run_log(newest, ended).withColumnRenamed("run_id", "id").orderBy(F.col("id").desc())


def unknown_finishes(starts: DataFrame, finishes: DataFrame) -> DataFrame:
    """Finish rows naming a run that never started: an error, not a run."""
    return finishes.join(starts.select("run_id"), "run_id", "left_anti")
