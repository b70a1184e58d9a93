"""One ingest run of one board, from fetched rows to the board's next version.

Below ``root``: ``posting`` (a ``BucketTable`` per source), ``change`` (ids to embed),
``run_start`` and ``run_finish``. Boards run side by side: each reads and writes its own table
alone. A run rewrites the buckets that its batch touches and no others. Rows that it merely
missed are not written at all: a table's version counts its board's successful runs, every row
knows the run it was last written by, and the difference is what it has missed since.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import ERROR_TEXT_LIMIT
from ..operators.ordered import number_rows
from ..operators.tracking import run_log
from ..operators.upsert import FLAGS, posting_status, upsert_counts, upsert_postings
from ..schemas import POSTING, ddl
from ..session import cut, remove
from ..sources.tables import append
from ..sources.versions import BucketTable, Version

#: Ids set aside for one run.
RUN_IDS = 1 << 32
#: Times a run joins again because another one of its board was quicker.
ATTEMPTS = 20
#: A stored posting and the number of its board's run that wrote it.
STORED = {**POSTING, "run_no": "bigint"}
RUN_START = (
    "run_id bigint, source string, keywords string, location string, started_at timestamp")
RUN_FINISH = (
    "run_id bigint, seq bigint, finished_at timestamp, fetched_count bigint, new_count bigint, "
    "updated_count bigint, error string")


def read_log(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """An append-only log, empty before its first row."""
    if not _exists(spark, f"{root}/{name}"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/{name}")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def runs(spark: SparkSession, root: str) -> DataFrame:
    """The run log: running, failed and finished runs."""
    return run_log(read_log(spark, root, "run_start", RUN_START),
                   read_log(spark, root, "run_finish", RUN_FINISH))


def board_table(spark: SparkSession, root: str, source: str, buckets: int = 32) -> BucketTable:
    """The stored postings of one board."""
    return BucketTable(
        spark, f"{root}/posting/source={quote(source, safe='')}", ddl(STORED), ["external_id"], buckets,
        order="id")


def caught_up(rows: DataFrame, runs_now: int) -> DataFrame:
    """Stored rows with the misses of the runs since they were written, and the status of those."""
    behind = F.lit(runs_now) - F.col("run_no")
    missed = F.coalesce("missed_run_count", F.lit(0)) + behind
    status = F.when(behind > 0, posting_status(F.col("source"), missed)).otherwise(
        F.coalesce("status", F.lit("active")))
    return rows.withColumns({"status": status, "missed_run_count": missed.cast("int")}).drop("run_no")


def _held(table: BucketTable, version: Version, buckets=None) -> DataFrame:
    return caught_up(table.read(version, buckets), version.facts.get("runs", 0))


def current_posting(spark: SparkSession, root: str, source: str | None = None) -> DataFrame:
    """The postings of every board, or one, as its last successful run left them."""
    if source is None:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/posting")
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        sources = sorted(unquote(n.removeprefix("source=")) for n in names if n.startswith("source="))
    else:
        sources = [source]
    # One table per board.
    tables = [board_table(spark, root, s) for s in sources]
    rows = spark.createDataFrame([], ddl(POSTING))
    for table in tables:
        version = table.newest()
        if version.folders:
            rows = rows.unionByName(_held(table, version))
    return rows


def with_ordinal(batch: DataFrame) -> DataFrame:
    """Number the rows of a fetched batch densely, in the order they were read.

    The batch is written once, so that its order stays; only source and position are numbered.
    """
    frozen = cut(batch.withColumn("_read", F.monotonically_increasing_id()), "batch")
    numbers = number_rows(frozen.select("source", "_read"), ["source"], "_read", "ordinal")
    return frozen.join(numbers, ["source", "_read"]).drop("_read")


def ingest_run(
    spark: SparkSession, root: str, run_id: int, source: str, fetch: Callable[[], DataFrame],
    as_of: Column, keywords: str = "", location: str = "", buckets: int = 32,
) -> dict[str, int]:
    """Fetch, upsert, count misses, queue changed ids, commit the buckets, log the run.

    A failing fetch is logged and raised again; it is no evidence that postings are
    gone, so nothing is counted as missed. New ids start at ``run_id`` times ``RUN_IDS``, so
    runs side by side never hand out the same ones. Ids are queued before the commit that
    stamps them; a run that another one of its board overtook joins again with what that one
    stored, and may queue an id twice or one that was never stored. ``buckets`` counts for a
    board's first run.
    """
    started = spark.range(1).select(
        F.lit(run_id).cast("bigint").alias("run_id"), F.lit(source).alias("source"),
        F.lit(keywords).alias("keywords"), F.lit(location).alias("location"),
        as_of.cast("timestamp").alias("started_at"))
    append(started, f"{root}/run_start")
    try:
        batch = with_ordinal(fetch().filter(F.col("source") == source))
        table = board_table(spark, root, source, buckets)
        counts = None
        for _ in range(ATTEMPTS):
            counts = _store(spark, root, run_id, source, table, batch, as_of)
            if counts is not None:
                break
        else:
            raise RuntimeError(f"{ATTEMPTS} other runs of {source} were quicker")
        counts["fetched_count"] = batch.count()
        remove(spark, batch)
    except Exception as error:
        _finish(spark, root, run_id, as_of, {}, str(error)[:ERROR_TEXT_LIMIT])
        raise
    _finish(spark, root, run_id, as_of, counts, None)
    return counts


def _store(
    spark: SparkSession, root: str, run_id: int, source: str, table: BucketTable,
    batch: DataFrame, as_of: Column,
) -> dict[str, int] | None:
    """One attempt to commit the batch on top of the newest version; None if overtaken."""
    version = table.newest()
    run_no = version.facts.get("runs", 0) + 1
    touched = table.touched(version, batch)
    upserted = upsert_postings(
        _held(table, version, touched), batch, as_of, source,
        F.lit(run_id * RUN_IDS).cast("bigint"))
    stamped = F.when(F.col("to_embed"), as_of).otherwise(F.col("embedding_queued_at"))
    folder = table.stage(version, upserted.withColumns({
        "embedding_queued_at": stamped.cast("timestamp"),
        "run_no": F.lit(run_no).cast("bigint")})) if touched else None
    counts = {"new_count": 0, "updated_count": 0, "to_embed_count": 0, "newly_removed_count": 0}
    if folder:
        kinds = {"is_new": "boolean", "update_rows": "bigint", "to_embed": "boolean",
                 "newly_removed": "boolean"}
        result = table.staged(folder, ddl({**STORED, **{f: kinds[f] for f in FLAGS}}))
        counts = upsert_counts(result).first().asDict()
        append(result.filter("to_embed").select(
            F.col("id").alias("vacancy_id"), as_of.cast("timestamp").alias("published_at")),
            f"{root}/change")
    # Missed rows of other buckets: four narrow columns are read, nothing is written.
    others = _held(table, version, version.folders.keys() - set(touched)).filter("status <> 'removed'")
    counts["newly_removed_count"] += others.filter(posting_status(
        F.col("source"), F.col("missed_run_count") + 1) == "removed").count()
    if table.commit(version, folder, touched, {"runs": run_no}):
        return counts
    if folder:
        table.discard(folder)
    return None


def _finish(
    spark: SparkSession, root: str, run_id: int, as_of: Column, counts: dict[str, int],
    error: str | None,
) -> None:
    row = spark.range(1).select(
        F.lit(run_id).cast("bigint").alias("run_id"), F.lit(time.time_ns()).cast("bigint").alias("seq"),
        as_of.cast("timestamp").alias("finished_at"),
        *[F.lit(counts.get(c)).cast("bigint").alias(c)
          for c in ("fetched_count", "new_count", "updated_count")],
        F.lit(error).cast("string").alias("error"))
    append(row, f"{root}/run_finish")
