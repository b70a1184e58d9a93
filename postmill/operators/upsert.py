"""Keyed upsert, missed-run lifecycle and cleanup of the posting table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    CLEANUP_MIN_AGE_DAYS, DEFAULT_REMOVED_AFTER, DEFAULT_STALE_AFTER, REMOVED_AFTER_RUNS,
    STALE_AFTER_RUNS,
)
from ..functions.values import days_before
from ..schemas import CONTENT, POSTING
from .filters import SALTS
from .ordered import number_rows

KEY = ["source", "external_id"]
FLAGS = ["is_new", "update_rows", "to_embed", "newly_removed"]


def _threshold(table: Mapping[str, int], source: Column, default: int) -> Column:
    if not table:
        return F.lit(default)
    pairs = [F.lit(item) for pair in table.items() for item in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), source), F.lit(default))


def posting_status(
    source: Column, missed: Column,
    stale: Mapping[str, int] = STALE_AFTER_RUNS, removed: Mapping[str, int] = REMOVED_AFTER_RUNS,
) -> Column:
    """active / stale / removed from a miss streak and the board's thresholds."""
    return (
        F.when(missed >= _threshold(removed, source, DEFAULT_REMOVED_AFTER), F.lit("removed"))
        .when(missed >= _threshold(stale, source, DEFAULT_STALE_AFTER), F.lit("stale"))
        .otherwise(F.lit("active"))
    )


def join_thresholds(df: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Add ``stale_after`` / ``removed_after`` from a table, defaults where a source is absent.

    No broadcast hint: Spark broadcasts the table when its size allows.
    """
    return (
        df.join(thresholds.select("source", "stale_after", "removed_after"), "source", "left")
        .withColumn("stale_after", F.coalesce("stale_after", F.lit(DEFAULT_STALE_AFTER)))
        .withColumn("removed_after", F.coalesce("removed_after", F.lit(DEFAULT_REMOVED_AFTER)))
    )


def fold_batch(batch: DataFrame) -> DataFrame:
    """One row per key: the last version, the first ordinal and how often it occurred.

    A hash aggregate over key, ordinal and a digest of the texts; a semi-join-like lookup by
    the last ordinal then brings in the content, so copies of one key shrink before the
    shuffle and no whole rows are sorted. ``texts_vary`` says whether title or description
    differ among the copies.
    """
    digest = F.xxhash64("title", F.lit("\u0001"), "description")
    folded = batch.groupBy(*KEY).agg(
        F.max("ordinal").alias("ordinal"), F.min("ordinal").alias("first_ordinal"),
        F.count(F.lit(1)).alias("copies"),
        (F.min(digest) != F.max(digest)).alias("texts_vary"),
    )
    fresh = batch.select(*KEY, "ordinal", F.struct(*CONTENT).alias("fresh"))
    return folded.join(fresh, [*KEY, "ordinal"]).drop("ordinal")


def upsert_postings(
    stored: DataFrame, batch: DataFrame, as_of: Column, missing_source: str | None = None,
    last_id: Column | None = None,
) -> DataFrame:
    """New snapshot of the posting table after one batch, plus the change flags.

    ``batch`` is folded to one row per key first (``fold_batch``), then joined (``upsert_folded``).
    """
    return upsert_folded(stored, fold_batch(batch), as_of, missing_source, last_id)


def upsert_folded(
    stored: DataFrame, folded: DataFrame, as_of: Column, missing_source: str | None = None,
    last_id: Column | None = None,
) -> DataFrame:
    """``upsert_postings`` for a batch that is folded already.

    One full outer join does it all: matched rows are refreshed, batch-only rows
    inserted, stored-only rows of ``missing_source`` get one more miss, the rest
    stays. The batch needs a unique ``ordinal`` (its row order); new ids are ``last_id``
    plus that ordinal + 1, so they rise in batch order without a global sort. ``last_id`` is
    the highest stored id unless a caller hands ids out otherwise: runs side by side and the
    parts of one run must not take it from the table they all change.
    """
    highest = last_id if last_id is not None else stored.agg(
        F.coalesce(F.max("id"), F.lit(0)).alias("m")).scalar()
    joined = stored.join(folded, KEY, "full_outer")
    seen = F.col("copies").isNotNull()
    is_new = F.col("id").isNull()
    gone = (~seen) & (F.col("source") == F.lit(missing_source)) if missing_source else F.lit(False)
    old_missed = F.coalesce(F.col("missed_run_count"), F.lit(0))
    old_status = F.coalesce(F.col("status"), F.lit("active"))
    missed = F.when(seen, F.lit(0)).when(gone, old_missed + 1).otherwise(old_missed)
    status = (
        F.when(seen, F.lit("active"))
        .when(gone, posting_status(F.col("source"), old_missed + 1))
        .otherwise(old_status)
    )
    edited = (
        ~F.col("title").eqNullSafe(F.col("fresh.title"))
        | ~F.col("description").eqNullSafe(F.col("fresh.description"))
        | F.col("texts_vary")
    )
    content = [F.when(seen, F.col(f"fresh.{c}")).otherwise(F.col(c)).alias(c) for c in CONTENT]
    return joined.select(
        F.coalesce("id", highest + F.col("first_ordinal") + 1).alias("id"),
        *KEY,
        *content,
        F.coalesce("first_seen_at", as_of).alias("first_seen_at"),
        F.when(seen, as_of).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        status.alias("status"),
        missed.cast("int").alias("missed_run_count"),
        "embedding_queued_at",
        is_new.alias("is_new"),
        F.coalesce(F.col("copies") - is_new.cast("int"), F.lit(0)).alias("update_rows"),
        F.coalesce(seen & (is_new | edited | F.col("embedding_queued_at").isNull()), F.lit(False))
        .alias("to_embed"),
        F.coalesce(gone & (status == "removed") & (old_status != "removed"), F.lit(False))
        .alias("newly_removed"),
    )


def snapshot(upserted: DataFrame) -> DataFrame:
    """The table columns of an upsert result."""
    return upserted.select(*POSTING)


def upsert_counts(upserted: DataFrame) -> DataFrame:
    """new / updated / to-embed / newly removed. ``updated`` counts batch rows."""
    return upserted.agg(
        F.count_if("is_new").alias("new_count"),
        F.coalesce(F.sum("update_rows"), F.lit(0)).cast("bigint").alias("updated_count"),
        F.count_if("to_embed").alias("to_embed_count"),
        F.count_if("newly_removed").alias("newly_removed_count"),
    )


def finish_run(stored: DataFrame, source: str, as_of: Column) -> DataFrame:
    """The table after a run of ``source`` that landed in parts: one miss for what none brought.

    Every part stamped ``last_seen_at`` with the run's time, so rows of the source with an
    earlier stamp, or none, were not in the run. Call it once, when the run has finished.
    """
    gone = (F.col("source") == F.lit(source)) & F.coalesce(F.col("last_seen_at") < as_of, F.lit(True))
    missed = F.coalesce("missed_run_count", F.lit(0)) + gone.cast("int")
    return stored.withColumns({
        "status": F.when(gone, posting_status(F.col("source"), missed)).otherwise(
            F.coalesce("status", F.lit("active"))),
        "missed_run_count": missed.cast("int")})


def anti_join_missing(stored: DataFrame, source: str, seen: DataFrame) -> DataFrame:
    """Stored rows of ``source`` whose external id is not in ``seen`` (empty: all rows)."""
    return stored.filter(F.col("source") == source).join(
        seen.select(F.lit(source).alias("source"), "external_id"), KEY, "left_anti")


def mark_missing(stored: DataFrame, source: str, seen: DataFrame) -> DataFrame:
    """Bump the streak of every unseen row of ``source`` and recompute its status."""
    marks = seen.select(F.lit(source).alias("source"), "external_id").distinct().withColumn(
        "_seen", F.lit(True))
    gone = (F.col("source") == source) & F.col("_seen").isNull()
    bumped = F.coalesce("missed_run_count", F.lit(0)) + 1
    old_status = F.coalesce("status", F.lit("active"))
    new_status = F.when(gone, posting_status(F.col("source"), bumped)).otherwise(old_status)
    return (
        stored.join(marks, KEY, "left")
        .withColumn("newly_removed", gone & (new_status == "removed") & (old_status != "removed"))
        .withColumn("_status", new_status)
        .withColumn("missed_run_count", F.when(gone, bumped)
                    .otherwise(F.coalesce("missed_run_count", F.lit(0))).cast("int"))
        .withColumn("status", F.col("_status"))
        .drop("_seen", "_status")
        .select(*stored.columns, "newly_removed")
    )


def mark_queued(stored: DataFrame, confirmed: DataFrame, as_of: Column) -> DataFrame:
    """Stamp ``embedding_queued_at`` on confirmed ids only."""
    marks = confirmed.select(F.col("vacancy_id").alias("id")).distinct().withColumn(
        "_ok", F.lit(True))
    return (
        stored.join(marks, "id", "left")
        .withColumn("embedding_queued_at",
                    F.when(F.col("_ok"), as_of).otherwise(F.col("embedding_queued_at")))
        .select(*stored.columns)
    )


def missed_run_streak(runs: DataFrame, sightings: DataFrame) -> DataFrame:
    """Successful runs of a posting's own source since it was last seen.

    ``runs(source, run)`` holds successful runs only, with an integer run number;
    ``sightings(source, external_id, run)`` the postings any run returned. What a
    failed run saw does not count, nor does the run itself.

    Sightings meet their run's position once; the short list of runs stands in ``SALTS``
    copies, since the newest run of a large board holds most of the sightings.
    """
    numbered = number_rows(runs.select("source", "run").distinct(), ["source"], "run", "run_no")
    latest = numbered.groupBy("source").agg(F.max("run_no").alias("latest_no"))
    listed = numbered.join(latest, "source").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("external_id"), F.lit(SALTS)).cast("int")
    return (
        sightings.withColumn("_salt", salt).join(listed, ["source", "run", "_salt"])
        .groupBy(*KEY)
        .agg((F.max("latest_no") - F.max("run_no")).alias("missed_run_count"))
    )


def distinct_history_ids(application: DataFrame, artifact: DataFrame) -> DataFrame:
    """Ids of postings with any user history."""
    return application.select("vacancy_id").union(artifact.select("vacancy_id")).distinct()


def cleanup_candidates(
    posting: DataFrame, application: DataFrame, artifact: DataFrame, as_of: Column,
    min_age_days: int = CLEANUP_MIN_AGE_DAYS,
) -> DataFrame:
    """Old removed postings, each marked ``deletable`` unless the user has history on it."""
    old = posting.filter(
        (F.col("status") == "removed") & (F.col("first_seen_at") < days_before(as_of, min_age_days)))
    history = distinct_history_ids(application, artifact).select(
        F.col("vacancy_id").alias("id"), F.lit(True).alias("_kept"))
    return (
        old.join(history, "id", "left")
        .withColumn("deletable", F.col("_kept").isNull())
        .drop("_kept")
    )


def cleanup_summary(candidates: DataFrame) -> DataFrame:
    return candidates.agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if("deletable").alias("to_delete"),
        F.count_if(~F.col("deletable")).alias("kept_for_history"),
    )


def delete_postings(
    posting: DataFrame, index: DataFrame, candidates: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """Posting and index tables without the deletable candidates."""
    doomed = candidates.filter("deletable").select("id")
    return (
        posting.join(doomed, "id", "left_anti"),
        index.join(doomed.withColumnRenamed("id", "vacancy_id"), "vacancy_id", "left_anti"),
    )
