import datetime as dt

import pytest
from helpers import NOW, batch, batch_row, posting, posting_row
from postmill.bindings.metrics import landed
from postmill.operators.upsert import finish_run, snapshot, upsert_folded, upsert_postings
from postmill.schemas import BATCH, CHANGE, POSTING, ddl
from postmill.session import shared_dir
from postmill.streaming import jobs
from pyspark.sql import functions as F


def test_a_run_in_five_files_is_one_run(spark):
    """Every file a micro-batch: the table is that of one batch, misses are counted once."""
    landing, table = shared_dir(spark, "landing"), shared_dir(spark, "table")
    old = [posting_row(i, external_id=str(i), source="justjoinit", last_seen_at=NOW - dt.timedelta(days=1))
           for i in range(1, 8)] + [posting_row(50, external_id="x", source="dou")]
    stored, at = posting(spark, *old), F.lit(NOW)
    rows = [batch_row(external_id=e, source="justjoinit", title=t) for e, t in
            [("1", "A"), ("2", "B"), ("9", "new"), ("2", "B again"), ("3", "C"), ("8", "new"), ("9", "edited"),
             ("4", "D"), ("5", "E"), ("10", "new")]]
    whole = batch(spark, *rows)
    for n in range(5):
        whole.filter(F.col("ordinal").between(2 * n, 2 * n + 1)).coalesce(1).write.mode("append").parquet(landing)
    done, reports = [], []

    def load():
        return spark.read.schema(ddl(POSTING)).parquet(done[-1]) if done else stored

    def store(result, batch_id):
        path = f"{table}/{batch_id}"
        result.write.mode("overwrite").parquet(path)
        done.append(path)

    changes = jobs.scan_change_stream(
        spark, landing, ddl({**BATCH, "ordinal": "bigint"}), files_per_trigger=1)
    jobs.drain(jobs.stream_upsert(
        changes, load, store, at, shared_dir(spark, "cp"), F.lit(50),
        lambda counts, i: reports.append(counts.first().new_count)))
    assert len(done) == 5 and sum(reports) == 3
    expected = {r.external_id: r for r in snapshot(
        upsert_postings(stored, whole, at, "justjoinit")).collect()}
    got = finish_run(load(), "justjoinit", at).collect()
    assert {r.external_id: (r.id, r.title, r.status, r.missed_run_count, r.first_seen_at) for r in got} == {
        e: (r.id, r.title, r.status, r.missed_run_count, r.first_seen_at) for e, r in expected.items()}
    assert {r.external_id for r in got if r.missed_run_count} == {"6", "7"}


def test_index_stream_delivers_until_the_vector_lands(spark):
    landing, out, checkpoint = (shared_dir(spark, n) for n in ("changes", "index", "cp"))
    stored = posting(spark, posting_row(1), posting_row(2))
    one = spark.createDataFrame([(1, [1.0, 0.0])], "vacancy_id bigint, embedding array<float>")
    both = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], one.schema)
    vectors = [one]

    def deliver(*ids):
        spark.createDataFrame([(i, NOW) for i in ids], ddl(CHANGE)).coalesce(1).write.mode(
            "append").parquet(landing)
        stream = jobs.scan_change_stream(spark, landing, ddl(CHANGE), files_per_trigger=1)
        jobs.drain(jobs.stream_index(stream, lambda: stored, lambda: vectors[-1], out, checkpoint))
        return {r.vacancy_id: r.status for r in jobs.latest_index(spark, out).collect()}

    assert deliver(1, 1, 2, 7, None) == {1: "indexed", 2: "retrying", 7: "not_found", None: "failed"}
    assert deliver(7)[2] == "retrying"  # still without a vector
    vectors.append(both)
    assert deliver(7) == {1: "indexed", 2: "indexed", 7: "not_found", None: "failed"}
    again = shared_dir(spark, "index")  # everything once more, from a new checkpoint
    stream = jobs.scan_change_stream(spark, landing, ddl(CHANGE), files_per_trigger=1)
    for _ in range(2):
        jobs.drain(jobs.stream_index(
            stream, lambda: stored, lambda: both, again, shared_dir(spark, "cp")))
    assert {r.vacancy_id: r.status for r in jobs.latest_index(spark, again).collect()} == {
        1: "indexed", 2: "indexed", 7: "not_found", None: "failed"}


def test_transient_failure_is_redelivered(spark):
    """A micro-batch that raises is replayed from its checkpoint."""
    landing, checkpoint = shared_dir(spark, "changes"), shared_dir(spark, "cp")
    spark.createDataFrame([(1, NOW)], ddl(CHANGE)).coalesce(1).write.parquet(landing)
    stored, calls = posting(spark, posting_row(1)), []

    def attempt(fail):
        def load():
            if fail:
                raise ConnectionError("store is down")
            return stored
        stream = jobs.scan_change_stream(spark, landing, ddl(CHANGE)).select(
            F.lit("adzuna").alias("source"), F.col("vacancy_id").cast("string").alias("external_id"),
            *[F.lit(None).cast(BATCH[c]).alias(c) for c in list(BATCH)[2:]], F.lit(0).cast("bigint").alias("ordinal"))
        return jobs.stream_upsert(stream, load, lambda rows, i: calls.append((i, rows.count())), F.lit(NOW), checkpoint)

    with pytest.raises(Exception, match="store is down"):
        jobs.drain(attempt(True))
    jobs.drain(attempt(False))
    assert calls == [(0, 1)]
    assert list(POSTING)[0] == "id"


def test_redelivered_events_count_once(spark):
    from postmill.operators.metrics import rate
    landing, out = shared_dir(spark, "events"), shared_dir(spark, "rate")
    start = dt.datetime(2026, 1, 1)
    rows = [(i, start + dt.timedelta(seconds=20 * i), "k") for i in range(30)]
    spark.createDataFrame(rows + rows[:10], "event_id bigint, ts timestamp, label string").coalesce(1).write.parquet(landing)
    stream = spark.readStream.schema("event_id bigint, ts timestamp, label string").parquet(landing)
    counted = rate(jobs.events_with_watermark(stream, "ts", "event_id"), "ts", ["label"])
    jobs.drain(jobs.write_updates(counted, out, shared_dir(spark, "cp")))
    assert sum(r.n for r in jobs.read_updates(spark, out, ["window_start", "label"]).collect()) == 30


def test_a_vector_lands_after_the_last_change(spark):
    """No new change comes: a timer delivers the waiting id, also after a restart."""
    landing, out, checkpoint = (shared_dir(spark, n) for n in ("changes", "index", "cp"))
    stored = posting(spark, *[posting_row(i) for i in range(1, 5)])
    schema = "vacancy_id bigint, embedding array<float>"
    vectors = [spark.createDataFrame([(1, [1.0, 0.0])], schema)]
    spark.createDataFrame([(i, NOW) for i in (1, 1, 2, 3, 4, 7, None)], ddl(CHANGE)).coalesce(1).write.parquet(landing)
    table = jobs.index_table(spark, out)

    def state():
        return {r.vacancy_id: r.status for r in table.read().collect()}

    def work(done):
        stream = jobs.scan_change_stream(spark, landing, ddl(CHANGE))
        query = jobs.stream_delivery(
            stream, lambda: stored, lambda: vectors[-1], out, checkpoint, pause_seconds=0.5, every="0 seconds")
        jobs.stop_when(query, done, 120)

    def land(*ids):
        vectors.append(spark.createDataFrame([(i, [float(i), 1.0]) for i in ids], schema))

    rest = {7: "not_found", None: "failed"}
    work(lambda: len(state()) == 6)
    assert state() == {1: "indexed", 2: "retrying", 3: "retrying", 4: "retrying", **rest}
    land(1, 2)  # while no query runs
    work(lambda: state()[2] == "indexed")
    late = []

    def lands_while_running():
        if not late:
            late.append(land(1, 2, 3))
        return state()[3] == "indexed"

    work(lands_while_running)
    assert state() == {1: "indexed", 2: "indexed", 3: "indexed", 4: "retrying", **rest}
    assert table.read().count() == 6  # one live row per id
    assert table.read().filter("vacancy_id = 3").first().embedding == [3.0, 1.0]


def test_only_waiting_ids_have_state(spark):
    """Ids that are settled at once leave nothing in the state store; waiting ones come again."""
    landing, out, checkpoint = (shared_dir(spark, n) for n in ("changes", "index", "cp"))
    stored = posting(spark, *[posting_row(i) for i in range(1, 4)])
    vectors = spark.createDataFrame([(1, [1.0, 0.0])], "vacancy_id bigint, embedding array<float>")
    spark.createDataFrame([(i, NOW) for i in range(1, 200)], ddl(CHANGE)).coalesce(1).write.parquet(landing)
    again = []
    query = jobs.stream_delivery(
        jobs.scan_change_stream(spark, landing, ddl(CHANGE)), lambda: stored, lambda: vectors, out, checkpoint,
        pause_seconds=0.2, every="0 seconds",
        report=lambda _, ids: again.append({r.vacancy_id for r in ids.collect()}))
    jobs.stop_when(query, lambda: sum(ids == {2, 3} for ids in again) >= 2, 120)
    assert again[0] == set(range(1, 200))
    assert all(ids <= {2, 3} for ids in again[1:])
    updated = [p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["stateOperators"]]
    assert max(updated) <= 6


def test_the_time_limit_starts_anew_with_progress(spark):
    class Query:
        stopped = False

        def exception(self):
            return None

        def stop(self):
            self.stopped = True

    query, calls = Query(), []

    def done():
        calls.append(1)
        return len(calls) > 8

    jobs.stop_when(query, done, 0.5, moved=lambda: len(calls))
    assert query.stopped
    calls.clear()
    with pytest.raises(TimeoutError):
        jobs.stop_when(Query(), done, 0.5, moved=lambda: 1)


def test_index_replaces_touched_buckets_only(spark):
    table = jobs.index_table(spark, shared_dir(spark, "index"), buckets=8)
    stored = posting(spark, *[posting_row(i) for i in range(1, 41)])
    schema = "vacancy_id bigint, embedding array<float>"
    first = spark.createDataFrame([(i, [float(i)]) for i in range(1, 41)], schema)
    jobs.store_index(table, first, stored, first)
    before = table.newest()
    one = spark.createDataFrame([(5, [50.0])], schema)
    jobs.store_index(table, one, stored, one)
    after = table.newest()
    assert [b for b in range(8) if before.folders[b] != after.folders[b]] == table.touched(after, one)
    untouched = set(range(8)) - set(table.touched(after, one))
    assert table.read(before, untouched).inputFiles() == table.read(after, untouched).inputFiles()
    got = {r.vacancy_id: r.embedding for r in table.read().collect()}
    assert got == {i: [50.0 if i == 5 else float(i)] for i in range(1, 41)}


def test_a_fold_that_fails_half_way_goes_on(spark):
    """Parts are folded in state; a restart from the checkpoint gives the table of one batch."""
    landing, out, checkpoint = (shared_dir(spark, n) for n in ("landing", "fold", "cp"))
    old = [posting_row(i, external_id=str(i), source="justjoinit", last_seen_at=NOW - dt.timedelta(days=1))
           for i in range(1, 8)]
    stored, at = posting(spark, *old), F.lit(NOW)
    rows = [batch_row(external_id=e, source="justjoinit", title=t) for e, t in
            [("1", "A"), ("2", "B"), ("9", "new"), ("2", "B again"), ("3", "C"), ("8", "new"), ("9", "edited"),
             ("4", "D"), ("9", "last"), ("10", "new")]]
    whole = batch(spark, *rows)
    schema = ddl({**BATCH, "ordinal": "bigint"})

    def land(low, high):
        whole.filter(F.col("ordinal").between(low, high)).coalesce(1).write.mode("append").parquet(landing)

    def work():
        stream = jobs.scan_change_stream(spark, landing, schema, files_per_trigger=1)
        jobs.drain(jobs.stream_fold(stream, out, checkpoint))

    land(0, 2)
    land(3, 5)
    work()
    with open(f"{landing}/broken.parquet", "w") as f:
        f.write("no parquet")
    with pytest.raises(Exception, match="broken.parquet|Parquet|PARQUET|footer"):
        work()
    with open(f"{landing}/broken.parquet", "wb") as f, open(_empty(spark, schema), "rb") as e:
        f.write(e.read())
    land(6, 7)
    land(8, 9)
    work()
    touched = [spark.read.parquet(f"{out}/batch_id={n}").count() for n in (0, 1)]
    assert touched == [3, 3]  # a part writes the keys it touched
    got = upsert_folded(stored, jobs.fold_of_run(spark, out), at, "justjoinit")
    want = upsert_postings(stored, whole, at, "justjoinit")

    def plain(frame):
        return sorted(str(tuple(r)) for r in frame.drop("posted_at").collect())

    assert plain(got) == plain(want)


def _empty(spark, schema):
    import glob
    place = shared_dir(spark, "empty")
    spark.createDataFrame([], schema).coalesce(1).write.parquet(place)
    return glob.glob(f"{place.removeprefix('file:')}/*.parquet")[0]


def test_landing_keeps_rows_without_an_order(spark):
    rows = spark.range(50).select(
        F.when(F.col("id") % 5 > 0, F.col("id")).alias("o"), F.col("id").alias("v"))
    out, checkpoint = shared_dir(spark, "landed"), shared_dir(spark, "cp")
    seen = []
    query = landed(spark, rows, "o", late=F.col("v") == 7).writeStream.foreachBatch(
        lambda b, i: seen.append(sorted(r.v for r in b.collect()))).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    jobs.drain(query)
    assert sorted(v for part in seen for v in part) == list(range(50))
    assert seen[0] == list(range(0, 50, 5)) and seen[-2:] == [[49], [7]]
    assert len(seen) == 9 and [v for part in seen[1:-1] for v in part] == [
        v for v in range(50) if v % 5 and v != 7]


def test_read_files_are_archived_and_broken_ones_counted(spark):
    base = shared_dir(spark, "landing")
    landing, archive, broken, out, checkpoint = (
        f"{base}/{n}" for n in ("in", "archive", "broken", "out", "cp"))

    def land(*ids):
        spark.createDataFrame([(i, NOW) for i in ids], ddl(CHANGE)).coalesce(1).write.mode("append").parquet(landing)

    def spoil(name):
        with open(f"{landing.removeprefix('file:')}/{name}", "w") as f:
            f.write("PAR1 but nothing more")

    def work():
        stream = jobs.scan_change_stream(
            spark, landing, ddl(CHANGE), glob="*.parquet", bytes_per_trigger=1000, archive=archive, skip_broken=True)
        jobs.drain(stream.writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", checkpoint).trigger(availableNow=True).start())

    land(1, 2)
    land()  # an empty file is not broken
    spoil("a.parquet")
    work()
    land(3)
    spoil("b.parquet")
    work()
    land(4)  # a file goes with the batch after the one that read it
    work()
    assert sorted(r.vacancy_id for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4]
    assert "a.parquet" in jobs.quarantine(spark, archive, broken)
    assert jobs.quarantine(spark, archive, broken) == []
    archived = {r.vacancy_id for r in spark.read.option("recursiveFileLookup", "true").schema(
        ddl(CHANGE)).parquet(archive).collect()}
    assert {1, 2} <= archived
