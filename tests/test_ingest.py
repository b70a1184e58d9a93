import datetime as dt

import pytest
from helpers import NOW, batch, batch_row
from postmill.operators.upsert import snapshot, upsert_postings
from postmill.plans.ingest import board_table, current_posting, ingest_run, runs, with_ordinal
from postmill.session import shared_dir
from postmill.sources.tables import one_of, write_by_id
from postmill.sources.versions import BucketTable
from pyspark.sql import functions as F


def at(hours):
    return F.lit(NOW + dt.timedelta(hours=hours))


def test_runs_of_two_boards(spark):
    root = shared_dir(spark, "store")

    def rows(*items):
        return lambda: batch(spark, *items).drop("ordinal")

    def fail():
        raise ConnectionError("board is down")

    one, two = batch_row(external_id="1", source="justjoinit"), batch_row(external_id="2", source="justjoinit")
    first = ingest_run(spark, root, 1, "justjoinit", rows(one, two), at(0), "php")
    assert first == {"new_count": 2, "updated_count": 0, "to_embed_count": 2, "newly_removed_count": 0, "fetched_count": 2}
    other = ingest_run(spark, root, 2, "dou", rows(batch_row(external_id="1", source="dou")), at(1))
    assert other["new_count"] == 1
    edited = {**one, "title": "Edited"}
    third = ingest_run(spark, root, 3, "justjoinit", rows(edited), at(2))
    assert (third["updated_count"], third["to_embed_count"]) == (1, 1)
    with pytest.raises(ConnectionError):
        ingest_run(spark, root, 4, "justjoinit", fail, at(3))
    fifth = ingest_run(spark, root, 5, "justjoinit", rows(edited), at(4))
    assert fifth["to_embed_count"] == 0  # confirmed and unchanged
    state = {(r.source, r.external_id): (r.title, r.status, r.missed_run_count) for r in current_posting(spark, root).collect()}
    assert state == {
        ("justjoinit", "1"): ("Edited", "active", 0), ("justjoinit", "2"): ("PHP Developer", "stale", 2),
        ("dou", "1"): ("PHP Developer", "active", 0)}
    ids = [r.id for r in current_posting(spark, root).collect()]
    assert len(set(ids)) == 3
    log = {r.run_id: (r.state, r.error) for r in runs(spark, root).collect()}
    assert {k: v[0] for k, v in log.items()} == {1: "ok", 2: "ok", 3: "ok", 4: "failed", 5: "ok"}
    assert "board is down" in log[4][1]
    queued = [r.vacancy_id for r in spark.read.parquet(f"{root}/change").collect()]
    assert len(queued) == 4 and len(set(queued)) == 3


def test_boards_side_by_side(spark, monkeypatch):
    """Run 1 starts first and finishes last; neither board's rows nor ids are lost."""
    root = shared_dir(spark, "store")
    inner = []

    def slow():
        inner.append(ingest_run(
            spark, root, 2, "dou", lambda: batch(spark, *[
                batch_row(external_id=str(i), source="dou") for i in range(3)]).drop("ordinal"), at(1)))
        return batch(spark, *[
            batch_row(external_id=str(i), source="justjoinit") for i in range(4)]).drop("ordinal")

    assert ingest_run(spark, root, 1, "justjoinit", slow, at(0))["new_count"] == 4
    assert inner[0]["new_count"] == 3
    rows = current_posting(spark, root).collect()
    assert sorted((r.source, r.external_id) for r in rows) == [
        *[("dou", str(i)) for i in range(3)], *[("justjoinit", str(i)) for i in range(4)]]
    assert len({r.id for r in rows}) == 7
    assert all(r.embedding_queued_at is not None for r in rows)
    queued = {r.vacancy_id for r in spark.read.parquet(f"{root}/change").collect()}
    assert queued == {r.id for r in rows}
    files = current_posting(spark, root, "dou").inputFiles()
    assert files and all("source=dou" in f for f in files)
    # A later run of the same board that finishes first does not hide one that finishes after it.
    ingest_run(spark, root, 4, "dou", lambda: batch(
        spark, batch_row(external_id="0", source="dou", title="Four")).drop("ordinal"), at(2))
    ingest_run(spark, root, 3, "dou", lambda: batch(
        spark, batch_row(external_id="0", source="dou", title="Three")).drop("ordinal"), at(3))
    assert {r.title for r in current_posting(spark, root, "dou").collect() if r.external_id == "0"} == {"Three"}


def test_ordinals_are_dense_and_in_reading_order(spark):
    rows = batch(spark, *[batch_row(external_id=str(i)) for i in range(30)]).drop("ordinal").coalesce(1)
    got = with_ordinal(rows).select("external_id", "ordinal").collect()
    assert sorted((r.ordinal, int(r.external_id)) for r in got) == [(i, i) for i in range(30)]


def test_a_small_batch_rewrites_its_buckets_only(spark):
    """Misses of all others are counted without writing them; the table equals one upsert."""
    root = shared_dir(spark, "store")

    def run(number, *ids, title="T"):
        return ingest_run(spark, root, number, "other", lambda: batch(spark, *[
            batch_row(external_id=str(i), source="other", title=title) for i in ids]).drop("ordinal"),
            at(number), buckets=16)

    run(1, *range(200))
    table = board_table(spark, root, "other")
    before = table.newest()
    assert set(before.folders) == set(range(16))
    expected = snapshot(upsert_postings(
        current_posting(spark, root), batch(spark, *[
            batch_row(external_id=str(i), source="other", title="new") for i in (7, 11)]), at(2), "other"))
    want = {tuple(r)[:-1] for r in expected.drop("posted_at", "tags").collect()}
    counts = run(2, 7, 11, title="new")
    after = table.newest()
    moved = {b for b in range(16) if after.folders[b] != before.folders[b]}
    assert moved == set(table.touched(before, spark.createDataFrame([("7",), ("11",)], "external_id string")))
    assert len(moved) <= 2 and counts["updated_count"] == 2
    # Only files of the touched buckets are read for the join.
    assert {f.rsplit("/", 2)[1] for f in table.read(before, moved).inputFiles()} == {f"bucket={b}" for b in moved}
    got = {tuple(r)[:-1] for r in current_posting(spark, root).drop("posted_at", "tags").collect()}
    assert got == want
    assert {r.status for r in current_posting(spark, root).filter("external_id not in ('7', '11')").collect()} == {"stale"}
    removed = [run(n, 7)["newly_removed_count"] for n in range(3, 7)]
    assert sum(removed) == 199 and max(removed) >= 198
    # An empty batch that was fetched well is a run in which all were missed.
    counts = run(7)
    assert counts["fetched_count"] == 0
    assert current_posting(spark, root).filter("external_id = '7'").first().missed_run_count == 1
    # A row seen again starts over.
    run(8, 3)
    row = current_posting(spark, root).filter("external_id = '3'").first()
    assert (row.status, row.missed_run_count) == ("active", 0)


def test_overlapping_runs_of_one_board_keep_both(spark):
    """Run 2 commits while run 1 is between reading and committing: run 1 joins again."""
    root, between = shared_dir(spark, "store"), []

    def rows(*ids):
        return lambda: batch(spark, *[
            batch_row(external_id=i, source="other", title=i) for i in ids]).drop("ordinal")

    ingest_run(spark, root, 1, "other", rows("a"), at(0), buckets=1)
    stage = BucketTable.stage

    def interrupted(self, version, frame):
        if not between:
            between.append(1)
            between.append(ingest_run(spark, root, 3, "other", rows("b", "c"), at(2)))
        return stage(self, version, frame)

    BucketTable.stage = interrupted
    try:
        first = ingest_run(spark, root, 2, "other", rows("a", "b"), at(1))
    finally:
        BucketTable.stage = stage
    assert between[1]["new_count"] == 2 and (first["new_count"], first["updated_count"]) == (0, 2)
    state = {r.external_id: (r.status, r.missed_run_count) for r in current_posting(spark, root).collect()}
    assert state == {"a": ("active", 0), "b": ("active", 0), "c": ("stale", 1)}
    ids = [r.id for r in current_posting(spark, root).collect()]
    assert len(ids) == len(set(ids)) == 3
    assert {r.state for r in runs(spark, root).collect()} == {"ok"}


def test_versions(spark):
    """A taken version is refused whole; replaced folders go some versions later."""
    table = BucketTable(spark, shared_dir(spark, "versions"), "k bigint, v string", ["k"], 4)
    frame = spark.createDataFrame([(i, "a") for i in range(20)], "k bigint, v string")
    base = table.newest()
    assert table.read().count() == 0
    assert table.commit(base, table.stage(base, frame), range(4))
    late = table.stage(base, frame)
    assert not table.commit(base, late, range(4))
    table.discard(late)
    for n in range(12):
        held = table.newest()
        one = frame.filter("k = 3").withColumn("v", F.lit(str(n)))
        touched = table.touched(held, one)
        kept = table.read(held, touched).filter("k <> 3")
        assert table.commit(held, table.stage(held, kept.unionByName(one)), touched)
    assert {(r.k, r.v) for r in table.read().collect()} == {(i, "11" if i == 3 else "a") for i in range(20)}
    place, fs = table._path("rows")
    buckets = [b.getPath().getName() for f in fs.listStatus(place) for b in fs.listStatus(f.getPath())
               if b.getPath().getName().startswith("bucket=")]
    assert buckets.count(f"bucket={touched[0]}") <= 9 and len(set(buckets)) == 4


def test_a_few_ids_read_a_few_row_groups(spark):
    """What the scan puts out, before the filter, is what its row groups hold."""
    base = shared_dir(spark, "by-id")
    rows = spark.range(0, 400_000, 2).select((F.col("id") * 7919 % 399_989).alias("id"), F.col("id").alias("v"))
    rows.repartition(8).write.parquet(f"{base}/plain")
    write_by_id(rows, f"{base}/clustered", files=16, **{
        "parquet.block.size": "65536", "parquet.page.row.count.limit": "400"})
    wanted = sorted(r.id for r in rows.filter("v % 20000 = 0").collect())
    assert len(wanted) == 20

    def read(path, ids):
        found = spark.read.parquet(path).filter(one_of("id", ids))
        got = sorted(r.id for r in found.collect())
        scan = found._jdf.queryExecution().executedPlan().collectLeaves().head()
        return got, scan.metrics().apply("numOutputRows").value()

    got, out = read(f"{base}/clustered", wanted)
    assert got == wanted and out < 20_000
    assert read(f"{base}/plain", wanted)[1] > 100_000
    # An id between others that is not there: the Bloom filter knows.
    absent = sorted(set(range(1000, 300_000, 9973)) - {r.id for r in rows.collect()})
    assert absent and read(f"{base}/clustered", absent)[1] < 20_000
