"""Streams: change rows to the embedding index, ingest batches to the posting table, metrics.

Delivery is at least once with effects keyed by posting, so replays change nothing:
an exception fails the micro-batch, which the checkpoint replays; a row that can
never succeed goes to the dead-letter output and is counted.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import TimerValues
from pyspark.sql.types import StructType

from ..operators.ordered import keep_last
from ..operators.upsert import KEY, snapshot, upsert_counts, upsert_postings
from ..schemas import CONTENT, INDEX, ddl
from ..sources.versions import BucketTable

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Times a writer of the index joins again because another one was quicker.
ATTEMPTS = 20
#: Keys of state that the ids waiting for redelivery share.
WAITING_GROUPS = 1024


def scan_change_stream(
    spark: SparkSession, directory: str, schema: StructType | str, glob: str | None = None,
    files_per_trigger: int | None = None, bytes_per_trigger: int | None = None,
    archive: str | None = None, skip_broken: bool = False,
) -> DataFrame:
    """Change rows landed as Parquet files.

    A micro-batch takes ``files_per_trigger`` files or about ``bytes_per_trigger``, not both.
    Files that were read move below ``archive``. With ``skip_broken`` a file that cannot be
    read does not stop the stream; ``quarantine`` finds it in the archive and counts it.
    """
    reader = spark.readStream.schema(schema)
    options = {
        "pathGlobFilter": glob, "maxFilesPerTrigger": files_per_trigger,
        "maxBytesPerTrigger": bytes_per_trigger, "ignoreCorruptFiles": "true" if skip_broken else None,
        "cleanSource": "archive" if archive else None, "sourceArchiveDir": archive,
    }
    for name, value in options.items():
        if value is not None:
            reader = reader.option(name, value)
    return reader.parquet(directory)


def quarantine(spark: SparkSession, archive: str, broken: str) -> list[str]:
    """Move unreadable files from ``archive`` to ``broken``; returns their names.

    One scan of no columns, footers alone, tells which files hold rows. Only the others, empty
    or broken, are opened one by one. Run it after the stream, on what it has archived since.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(archive)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    listed, names = fs.listFiles(folder, True) if fs.exists(folder) else None, []
    while listed is not None and listed.hasNext():
        path = listed.next().getPath()
        if path.getName().endswith(".parquet"):
            names.append(path.toString())
    if not names:
        return []
    readable = {hadoop.Path(r.file_path).toUri().getPath() for r in (
        spark.read.option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true")
        .schema("_none string").parquet(archive).select("_metadata.file_path").distinct().collect())}
    fs.mkdirs(hadoop.Path(broken))
    moved = []
    for name in names:
        path = hadoop.Path(name)
        if path.toUri().getPath() in readable:
            continue
        try:
            spark.read.parquet(name)
        except Exception:  # whatever is wrong with it, it cannot be read
            fs.rename(path, hadoop.Path(f"{broken}/{path.getName()}"))
            moved.append(path.getName())
    return sorted(moved)


def drain(query: StreamingQuery) -> None:
    """Wait until an ``availableNow`` query has read everything."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def index_rows(changes: DataFrame, posting: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row per changed id with its index document and status.

    ``indexed`` has a posting and a vector, ``not_found`` lacks the posting, ``failed`` has an
    id that is no number; ``retrying`` has a posting whose vector has not landed yet.
    """
    ids = changes.select("vacancy_id").distinct()
    # Semi-joins first: a small batch of ids is broadcast and the big tables are
    # scanned where they lie, instead of being shuffled for every batch.
    card = (
        posting.select(F.col("id").alias("vacancy_id"), "source", "title", "company", "url")
        .join(ids, "vacancy_id", "left_semi")
        .withColumn("_row", F.lit(True))
    )
    found = vectors.select("vacancy_id", "embedding").join(ids, "vacancy_id", "left_semi")
    status = (
        F.when(F.col("vacancy_id").isNull(), F.lit("failed"))
        .when(F.col("_row").isNull(), F.lit("not_found"))
        .when(F.col("embedding").isNull(), F.lit("retrying"))
        .otherwise(F.lit("indexed"))
    )
    return (
        ids.join(card, "vacancy_id", "left")
        .join(found, "vacancy_id", "left")
        .withColumn("status", status)
        .drop("_row")
    )


def index_postings(index: DataFrame, rows: DataFrame) -> DataFrame:
    """The index after a keyed overwrite with the ``indexed`` rows."""
    fresh = rows.filter("status = 'indexed'").select(*index.columns)
    return index.join(fresh.select("vacancy_id"), "vacancy_id", "left_anti").unionByName(fresh)


def index_table(spark: SparkSession, out: str, buckets: int = 32) -> BucketTable:
    """The stored index: one row per id, with its status."""
    return BucketTable(spark, out, ddl(INDEX), ["vacancy_id"], buckets, order="vacancy_id")


def store_index(table: BucketTable, ids: DataFrame, posting: DataFrame, vectors: DataFrame) -> None:
    """Look ``ids`` up and put their rows in place of those stored for them.

    Only the buckets that the ids fall into are read and written; a writer that another one
    overtook reads them again.
    """
    asked = ids.select("vacancy_id").distinct().persist()
    try:
        for _ in range(ATTEMPTS):
            version = table.newest()
            touched = table.touched(version, asked)
            if not touched:
                return
            stored = table.read(version, touched)
            kept = stored.join(asked.withColumnRenamed("vacancy_id", "_id"), F.col(
                "vacancy_id").eqNullSafe(F.col("_id")), "left_anti")
            rows = index_rows(asked, posting, vectors).select(*INDEX)
            folder = table.stage(version, kept.unionByName(rows))
            if table.commit(version, folder, touched):
                return
            table.discard(folder)
        raise RuntimeError(f"{ATTEMPTS} other writers were quicker")
    finally:
        asked.unpersist()


def waiting_ids(table: BucketTable) -> DataFrame:
    """Ids whose vector has not landed; two narrow columns are read."""
    return table.read().filter("status = 'retrying'").select("vacancy_id")


def stream_index(
    changes: DataFrame, posting: Callable[[], DataFrame], vectors: Callable[[], DataFrame],
    out: str, checkpoint: str,
) -> StreamingQuery:
    """Index what has landed, batch by batch, and end.

    ``posting`` and ``vectors`` are loaded for every batch, so rows landed meanwhile are
    found. Ids left ``retrying`` are looked up again with each batch, until their vector
    lands. Rows are replaced by id, so a replayed batch changes nothing. ``stream_delivery``
    goes on without new changes.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        table = index_table(batch.sparkSession, out)
        ids = batch.select("vacancy_id").unionByName(waiting_ids(table))
        store_index(table, ids, posting(), vectors())

    return (
        changes.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


class Redelivery(StatefulProcessor):
    """Hands a waiting id on ``pause_ms`` after it was found to wait, once.

    Its state is the time of its next delivery, which a timer watches over. If that delivery
    finds it waiting again, it comes in again. Ids share ``WAITING_GROUPS`` keys of state by
    their hash: a call to the state store serves all ids of a key, not one.
    """

    def __init__(self, pause_ms: int):
        self.pause_ms = pause_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "ids array<bigint>, at array<bigint>")

    def _held(self) -> dict[int, int]:
        held = self.due.get()
        return dict(zip(held[0], held[1], strict=True)) if held is not None else {}

    def handleInputRows(self, key, rows, timerValues: TimerValues) -> Iterator[Row]:
        at = timerValues.getCurrentProcessingTimeInMs() + self.pause_ms
        held = self._held() | {row.vacancy_id: at for row in rows}
        self.handle.registerTimer(at)
        self.due.update(([*held], [*held.values()]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo) -> Iterator[Row]:
        now, held = expiredTimerInfo.getExpiryTimeInMs(), self._held()
        rest = {i: at for i, at in held.items() if at > now}
        if rest:
            self.due.update(([*rest], [*rest.values()]))
        else:
            self.due.clear()
        for i, at in held.items():
            if at <= now:
                yield Row(vacancy_id=i)

    def close(self) -> None:
        pass


def stream_delivery(
    changes: DataFrame, posting: Callable[[], DataFrame], vectors: Callable[[], DataFrame],
    out: str, checkpoint: str, pause_seconds: float = 5.0, every: str = "1 second",
    report: Callable[[int, DataFrame], None] | None = None,
) -> StreamingQuery:
    """Index changed ids as they land and deliver waiting ones again by timer. Runs until stopped.

    A changed id is delivered at once and needs no state. Only an id that is left ``retrying``
    has a time of its next delivery there (``Redelivery``): it comes back every ``pause_seconds``, with or without new
    changes, until it is ``indexed``, ``not_found`` or ``failed``. Waiting ids are a second
    input of the query, read from ``out/waiting``, where every batch puts them and whose files
    go once they were read. Delivery is at least once: an id that changed while it waited may
    come once more after it was settled, and is then replaced by the same row.

    The query is started with the RocksDB state store, which state with timers needs; the
    session keeps its own setting. ``report`` gets the batch id and the ids of every batch.
    """
    spark = changes.sparkSession
    waiting = f"{out}/waiting"
    shape = "vacancy_id bigint"
    spark.createDataFrame([], shape).write.mode("append").parquet(waiting)
    again = (
        spark.readStream.schema(shape).option("cleanSource", "delete").parquet(waiting)
        .withColumn("_group", F.pmod(F.xxhash64("vacancy_id"), F.lit(WAITING_GROUPS)))
        .groupBy("_group")
        .transformWithState(
            Redelivery(int(1000 * pause_seconds)), "vacancy_id bigint", "Update", "ProcessingTime"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        if not batch.isEmpty():
            table = index_table(spark, out)
            store_index(table, batch, posting(), vectors())
            version = table.newest()
            held = table.read(version, table.touched(version, batch)).filter("status = 'retrying'").join(
                batch, "vacancy_id", "left_semi")
            held.select("vacancy_id").write.mode("append").parquet(waiting)
        if report is not None:
            report(batch_id, batch)
        batch.unpersist()

    writer = (
        changes.select("vacancy_id").unionByName(again)
        .writeStream.foreachBatch(write).outputMode("update")
        .option("checkpointLocation", checkpoint).trigger(processingTime=every)
    )
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKS_DB)
    try:
        return writer.start()  # a query takes a copy of the session's settings along
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


def stop_when(
    query: StreamingQuery, done: Callable[[], bool], seconds: float,
    moved: Callable[[], object] | None = None,
) -> None:
    """Let a running query work until ``done``, then stop it; an error if time runs out first.

    The time starts anew whenever ``moved`` gives another value than before.
    """
    seen, end = None, time.monotonic() + seconds
    try:
        while not done():
            if query.exception() is not None:
                raise query.exception()
            now = moved() if moved is not None else None
            if now != seen:
                seen, end = now, time.monotonic() + seconds
            if time.monotonic() > end:
                raise TimeoutError(f"not done after {seconds} s")
            time.sleep(0.2)
    finally:
        query.stop()


def _newest(spark: SparkSession, out: str, keys: Sequence[str]) -> DataFrame:
    return keep_last(spark.read.parquet(out), keys, "batch_id").drop("batch_id")


def latest_index(spark: SparkSession, out: str) -> DataFrame:
    """Each id's row."""
    return index_table(spark, out).read()


def stream_status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def stream_upsert(
    batches: DataFrame, load: Callable[[], DataFrame], store: Callable[[DataFrame, int], None],
    as_of: Column, checkpoint: str, last_id: Column | None = None,
    report: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Upsert a run that lands in several files: each micro-batch is a part of it.

    ``load`` reads the snapshot last stored, ``store`` writes the next one under the batch id;
    a replay writes the same snapshot again. What a part does not bring another may, so
    nothing is counted as missed here: ``finish_run`` does that once, when the run is over.
    ``last_id`` is the highest id before the run, the same for all of its parts.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        result = upsert_postings(load(), batch, as_of, last_id=last_id)
        store(snapshot(result), batch_id)
        if report is not None:
            report(upsert_counts(result), batch_id)

    return (
        batches.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def stream_fold(batches: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Fold a run that lands in parts, in a streaming state per posting.

    The state of a key is its last version, first ordinal and number of copies so far, as
    ``fold_batch`` makes them of a whole batch. A micro-batch reads its own rows and writes
    the keys it touched, under its id; a replay overwrites them. ``fold_of_run`` is the
    outcome.
    """
    digest = F.xxhash64("title", F.lit("\u0001"), "description")
    folded = batches.groupBy(*KEY).agg(
        F.max_by(F.struct(*CONTENT), "ordinal").alias("fresh"),
        F.min("ordinal").alias("first_ordinal"), F.count(F.lit(1)).alias("copies"),
        (F.min(digest) != F.max(digest)).alias("texts_vary"))
    return write_updates(folded, out, checkpoint)


def fold_of_run(spark: SparkSession, out: str) -> DataFrame:
    """One row per key of the run, for ``upsert_folded``: misses are counted there, once."""
    return read_updates(spark, out, KEY)


def write_windows(
    aggregated: DataFrame, out: str, checkpoint: str,
) -> StreamingQuery:
    """Append closed windows of a watermarked aggregation to Parquet."""
    return (
        aggregated.writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def write_updates(aggregated: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write the groups that a batch changed under its id; a replay overwrites them.

    Update mode: closed windows leave the state, and unchanged ones are not written again.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return (
        aggregated.writeStream.foreachBatch(write).outputMode("update")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_updates(spark: SparkSession, out: str, keys: Sequence[str]) -> DataFrame:
    """The newest value of every group, open windows included."""
    return _newest(spark, out, keys)


def events_with_watermark(events: DataFrame, ts: str, event_id: str, delay: str = "10 minutes") -> DataFrame:
    """Event-time column, watermark and redelivery removal."""
    return (
        events.withColumn(ts, F.col(ts).cast("timestamp"))
        .withWatermark(ts, delay)
        .dropDuplicatesWithinWatermark([event_id])
    )
