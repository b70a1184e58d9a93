"""Counters, rates, latency quantiles and the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import DURATION_BOUNDS
from ..operators import metrics as mt
from ..operators.upsert import upsert_folded
from ..session import shared_dir
from ..streaming import jobs
from .lifecycle import upsert_sql
from .registry import query
from .tables import (
    RUN_AT, RUN_SOURCE, RUN_START, ntz, order_store, posting, row_count, table, versions_of,
)

BOUNDS = [*DURATION_BOUNDS]


def events(spark, d):
    return table(spark, d, "events")


BOUND_ROWS = ", ".join(f"({i}, '{b}', CAST({b} AS DOUBLE))" for i, b in enumerate(BOUNDS, 1))


@query("duration_histogram", f"""
SELECT event_type, le, count(*) FILTER (WHERE value <= bound) AS cumulative
FROM events, (VALUES {BOUND_ROWS}, ({len(BOUNDS) + 1}, '+Inf', CAST('inf' AS DOUBLE))) v(i, le, bound)
GROUP BY event_type, le""")
def _duration_histogram(spark, d):
    return mt.duration_histogram(events(spark, d), "value", ["event_type"])


def quantile_sql(counts: str) -> str:
    """Interpolation over cumulative counts c1..c11 and the total."""
    cases = []
    for i, bound in enumerate(BOUNDS, 1):
        low = BOUNDS[i - 2] if i > 1 else 0.0
        below = f"c{i - 1}" if i > 1 else "0"
        cases.append(
            f"WHEN c{i} >= CAST(0.95 AS DOUBLE) * total THEN CAST({low} AS DOUBLE) + (CAST({bound} AS DOUBLE) "
            f"- CAST({low} AS DOUBLE)) * (CAST(0.95 AS DOUBLE) * total - {below}) / (c{i} - {below})")
    return f"CASE {' '.join(cases)} ELSE CAST({BOUNDS[-1]} AS DOUBLE) END"


CUMULATIVE = ", ".join(
    f"count(*) FILTER (WHERE value <= CAST({b} AS DOUBLE)) AS c{i}" for i, b in enumerate(BOUNDS, 1))


@query("quantile_p95", f"""SELECT user_id, round({quantile_sql('')}, 9) AS quantile FROM (
  SELECT user_id, {CUMULATIVE}, count(*) AS total FROM events GROUP BY user_id)""")
def _quantile_p95(spark, d):
    return mt.quantile_p95(events(spark, d), "value", ["user_id"]).select(
        "user_id", F.round("quantile", 9).alias("quantile"))


RATE_SQL = """SELECT time_bucket(INTERVAL '{w}', ts) AS window_start, {labels}, count(*) AS n,
  count(*) / {s}.0 AS per_second FROM events GROUP BY ALL"""


@query("publish_rate", "SELECT window_start, event_type, n, CAST(per_second AS DOUBLE) AS per_second FROM ("
       + RATE_SQL.format(w="1 minute", labels="event_type", s=60) + ")")
def _publish_rate(spark, d):
    return mt.rate(events(spark, d), "ts", ["event_type"])


@query("request_rate", """SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start, event_type AS handler,
  CASE WHEN value >= 100 THEN '500' ELSE '200' END AS status, count(*) AS n,
  CAST(count(*) AS DOUBLE) / 300 AS per_second FROM events GROUP BY ALL""")
def _request_rate(spark, d):
    rows = events(spark, d).select(
        "ts", F.col("event_type").alias("handler"),
        F.when(F.col("value") >= 100, F.lit("500")).otherwise(F.lit("200")).alias("status"))
    return mt.rate(rows, "ts", ["handler", "status"], "5 minutes", 300)


LATENCY_SQL = f"""
WITH panes AS (SELECT date_trunc('minute', ts) AS pane, event_type, value FROM events),
spread AS (SELECT pane - to_minutes(k) AS window_start, event_type, value FROM panes, range(5) r(k)),
counted AS (SELECT window_start, event_type, {CUMULATIVE}, count(*) AS total FROM spread GROUP BY ALL)
SELECT window_start, event_type, total AS n, round({quantile_sql('')}, 9) AS quantile FROM counted"""


@query("latency_p95", LATENCY_SQL)
def _latency_p95(spark, d):
    rows = mt.latency_quantile_paned(events(spark, d), "ts", "value", ["event_type"])
    return rows.withColumn("quantile", F.round("quantile", 9))


@query("queue_depth", """
WITH picked AS (SELECT l_orderkey, bool_and(l_linestatus = 'F') AS finished FROM lineitem GROUP BY 1)
SELECT date_trunc('month', o_orderdate) AS bucket,
       CASE WHEN finished IS NULL THEN 'ready' WHEN NOT finished THEN 'unacked' ELSE 'done' END AS state,
       count(*) AS n
FROM orders LEFT JOIN picked ON l_orderkey = o_orderkey GROUP BY ALL""")
def _queue_depth(spark, d):
    """Orders are published, line items are the processing of them."""
    changes = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("vacancy_id"), F.col("o_orderdate").alias("published_at"))
    processed = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("vacancy_id"), (F.col("l_linestatus") == "F").alias("finished"))
    return mt.queue_depth(changes, processed, "published_at", "month").withColumn(
        "bucket", F.col("bucket").cast("timestamp_ntz"))


# --- streams over the tables as landed files --------------------------------------------------

#: Files that a table lands in at least, and rows of one; a file makes a micro-batch.
FILES = 6
FILE_ROWS = 2_000_000


def landed(spark, rows, order, late=None):
    """``rows`` as files in the order of ``order``, those marked ``late`` after all others.

    One parallel write, a task per file; the number of files follows the number of rows. Rows
    without an order come first, in a file of their own. The highest of the others are a file
    of their own as well: a batch drops what was late for the watermark of the batch before it.
    """
    place = shared_dir(spark, "landing")
    at = F.col(order).cast("double")
    held_back = F.coalesce(late, F.lit(False)) if late is not None else F.lit(False)
    seen = rows.filter(~held_back)
    files = max(FILES, -(-seen.count() // FILE_ROWS))
    cuts = seen.select(
        F.percentile_approx(at, [i / files for i in range(1, files)]).alias("p"),
        F.max(at).alias("top")).first()
    edges = F.array(*[F.lit(float(p)) for p in cuts.p or []])
    part = (
        F.when(held_back, files + 2).when(at.isNull(), 0).when(at >= cuts.top, files + 1)
        .otherwise(1 + F.size(F.filter(edges, lambda e: e < at))))
    rows.withColumn("_part", part).repartitionByRange(files + 3, "_part").write.partitionBy(
        "_part").parquet(f"{place}/_parts")
    # The source reads files by age: one listing gives them their names and times.
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(f"{place}/_parts")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop.Path(f"{place}/files"))
    names = [s.getPath() for s in fs.listStatus(folder) if "=" in s.getPath().getName()]
    for path in sorted(names, key=lambda p: int(p.getName().split("=")[1])):
        number = int(path.getName().split("=")[1])
        for i, file in enumerate(s.getPath() for s in fs.listStatus(path)):
            target = hadoop.Path(f"{place}/files/{number:06d}-{i:03d}.parquet")
            fs.rename(file, target)
            fs.setTimes(target, 1_000_000_000_000 + 1000 * number, -1)
    return jobs.scan_change_stream(spark, f"{place}/files", rows.schema, files_per_trigger=1)


def stream_of(spark, d, name, order):
    return landed(spark, table(spark, d, name), order)


def event_stream(spark, d, late=None):
    """Events in the order of their time; the cast keeps the time as the watermark wants it."""
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return landed(spark, rows, "ts", late)


def _updated(spark, rows, name, keys):
    """Run an aggregated stream to its end and read the newest value of every group."""
    out = shared_dir(spark, name)
    jobs.drain(jobs.write_updates(rows, out, shared_dir(spark, f"{name}-checkpoint")))
    return jobs.read_updates(spark, out, keys)


def _plain(rows):
    return rows.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("scan_change_stream", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _scan_change_stream(spark, d):
    counted = event_stream(spark, d).groupBy("event_type").agg(row_count())
    return _updated(spark, counted, "change-counts", ["event_type"])


@query("stream_publish_rate", "SELECT window_start, event_type, n, CAST(per_second AS DOUBLE) AS per_second FROM ("
       + RATE_SQL.format(w="1 minute", labels="event_type", s=60) + ")")
def _stream_publish_rate(spark, d):
    rows = jobs.events_with_watermark(event_stream(spark, d), "ts", "event_id")
    return _plain(_updated(
        spark, mt.rate(rows, "ts", ["event_type"]), "publish-rate", ["window_start", "event_type"]))


@query("stream_latency_p95", LATENCY_SQL)
def _stream_latency_p95(spark, d):
    rows = jobs.events_with_watermark(event_stream(spark, d), "ts", "event_id")
    result = mt.latency_quantile(rows, "ts", "value", ["event_type"])
    latest = _updated(spark, result, "latency", ["window_start", "event_type"])
    return _plain(latest).withColumn("quantile", F.round("quantile", 9))


@query("late_data", """
WITH top AS (SELECT max(ts) AS top FROM events WHERE event_id % 10 <> 0),
mark AS (SELECT max(ts) FILTER (WHERE event_id % 10 <> 0 AND ts < top) - INTERVAL 10 MINUTE AS main,
                max(ts) - INTERVAL 10 MINUTE AS last FROM events, top)
SELECT * FROM (
  SELECT time_bucket(INTERVAL '1 minute', ts) AS window_start, event_type, count(*) AS n
  FROM events, mark WHERE event_id % 10 <> 0 OR ts > main GROUP BY ALL)
WHERE window_start + INTERVAL 1 MINUTE <= (SELECT last FROM mark)""")
def _late_data(spark, d):
    """Every tenth event lands after all others: what the watermark has passed is dropped.

    Append mode emits a window once the watermark has passed its end.
    """
    rows = jobs.events_with_watermark(
        event_stream(spark, d, late=F.col("event_id") % 10 == 0), "ts", "event_id")
    out = shared_dir(spark, "closed-windows")
    jobs.drain(jobs.write_windows(
        mt.rate(rows, "ts", ["event_type"]), out, shared_dir(spark, "closed-windows-checkpoint")))
    return _plain(spark.read.parquet(out)).select("window_start", "event_type", "n")


def _changed(spark, d):
    """Every order number is a changed id: some have a posting, fewer have a vector."""
    changes = stream_of(spark, d, "orders", "o_orderkey").select(
        F.col("o_orderkey").alias("vacancy_id"))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("vacancy_id"), "embedding")
    return changes, vectors


def _indexed(spark, d):
    """Half of the vectors land while the stream runs, so their postings are delivered again."""
    changes, vectors = _changed(spark, d)
    loads = []

    def landed_vectors():
        loads.append(1)
        return vectors if len(loads) > FILES // 2 else vectors.filter("vacancy_id % 2 = 0")

    out = shared_dir(spark, "index")
    jobs.drain(jobs.stream_index(
        changes, lambda: posting(spark, d), landed_vectors, out, shared_dir(spark, "index-checkpoint")))
    return jobs.latest_index(spark, out)


def _delivered(spark, d):
    """The odd vectors land after the last change: timers alone bring their postings again."""
    changes, vectors = _changed(spark, d)
    out, state = shared_dir(spark, "index"), {"late": False, "quiet": 0}

    def landed_vectors():
        return vectors if state["late"] else vectors.filter("vacancy_id % 2 = 0")

    def report(batch_id, ids):
        state["quiet"] = state["quiet"] + 1 if ids.isEmpty() else 0

    query = jobs.stream_delivery(
        changes, lambda: posting(spark, d), landed_vectors, out,
        shared_dir(spark, "index-checkpoint"), pause_seconds=1.0, every="0 seconds", report=report)
    index = jobs.index_table(spark, out)

    def read():
        """All changes were read: the last progress had none and the index holds some."""
        last = query.lastProgress
        return last is not None and last.batchId > FILES and not last.sources[0].numInputRows

    def batches():
        """The number of the last batch, until all changes were read."""
        last = query.lastProgress
        if last is not None and not state["late"]:
            state["batch"] = last.batchId
        return state.get("batch")

    def finished():
        if not state["late"]:
            state["late"] = read()
            return False
        held = jobs.waiting_ids(index).join(vectors, "vacancy_id", "left_semi")
        return held.isEmpty()

    jobs.stop_when(query, finished, 600, batches)
    return jobs.latest_index(spark, out)


INDEXED_SQL = """indexed AS (
  SELECT o_orderkey AS vacancy_id, source, d.doc_id, e.vec_id,
         CASE WHEN d.doc_id IS NULL THEN 'not_found' WHEN e.vec_id IS NULL THEN 'retrying' ELSE 'indexed' END AS status
  FROM orders LEFT JOIN documents d ON d.doc_id = o_orderkey LEFT JOIN embeddings e ON e.vec_id = d.doc_id)"""


@query("stream_index", f"WITH {INDEXED_SQL} SELECT vacancy_id, source FROM indexed WHERE status = 'indexed'")
def _stream_index(spark, d):
    return _indexed(spark, d).filter("status = 'indexed'").select("vacancy_id", "source")


@query("stream_status_counts", f"WITH {INDEXED_SQL} SELECT status, count(*) AS n FROM indexed GROUP BY status")
def _stream_status_counts(spark, d):
    return jobs.stream_status_counts(_indexed(spark, d))


@query("stream_delivery", f"WITH {INDEXED_SQL} SELECT vacancy_id, status FROM indexed WHERE status <> 'indexed'")
def _stream_delivery(spark, d):
    """The dead letters, and what still waits, once all vectors have landed."""
    return _delivered(spark, d).filter("status <> 'indexed'").select("vacancy_id", "status")


@query("index_postings", """
SELECT d.doc_id AS vacancy_id, d.source, e.label FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id
WHERE d.lang = 'en'
UNION ALL SELECT vec_id, 'old', label FROM embeddings
WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')""")
def _index_postings(spark, d):
    """An index of old documents, of which one language is indexed again."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("vacancy_id"), "embedding", "label")
    old = vectors.select("vacancy_id", F.lit("old").alias("source"), "embedding")
    changed = table(spark, d, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("vacancy_id"))
    rows = jobs.index_rows(changed, posting(spark, d), vectors)
    return jobs.index_postings(old, rows).join(
        vectors.select("vacancy_id", "label"), "vacancy_id").select("vacancy_id", "source", "label")


@query("stream_upsert", f"""{upsert_sql()}
SELECT id, source, external_id, title, salary_min, first_seen_at, last_seen_at, status, missed_run_count FROM result""")
def _stream_upsert(spark, d):
    """The run in several micro-batches: a state per posting folds it, one join stores it."""
    out = shared_dir(spark, "posting")
    batch = versions_of(stream_of(spark, d, "orders", "o_orderkey")).filter(
        F.col("posted_at") >= ntz(RUN_START))
    jobs.drain(jobs.stream_fold(batch, out, shared_dir(spark, "posting-checkpoint")))
    return upsert_folded(
        order_store(spark, d), jobs.fold_of_run(spark, out), ntz(RUN_AT), RUN_SOURCE).select(
        "id", "source", "external_id", "title", "salary_min", "first_seen_at", "last_seen_at", "status",
        "missed_run_count")
