import datetime as dt

import pytest
from helpers import NOW, application, batch, batch_row, posting, posting_row
from postmill.operators import upsert as up
from postmill.operators.upsert import finish_run
from postmill.sources.tables import write_bucketed
from pyspark.sql import functions as F

LATER = NOW + dt.timedelta(hours=1)


def run(spark, stored, rows, source=None, at=LATER):
    """One ingest run: (rows by key, counts)."""
    result = up.upsert_postings(stored, batch(spark, *rows), F.lit(at), source).cache()
    counts = tuple(up.upsert_counts(result).first())
    return {(r.source, r.external_id): r for r in result.collect()}, counts, up.snapshot(result)


def test_new_row(spark):
    rows, counts, _ = run(spark, posting(spark), [batch_row()], "adzuna")
    assert counts == (1, 0, 1, 0)
    row = rows["adzuna", "123"]
    assert (row.id, row.status, row.missed_run_count, row.first_seen_at) == (1, "active", 0, LATER)


@pytest.mark.parametrize(("change", "stamp", "queued"), [
    ({}, NOW, 0), ({"description": "Edited."}, NOW, 1), ({"title": "Other"}, NOW, 1),
    ({"salary_min": 5.0}, NOW, 0), ({}, None, 1),
])
def test_refresh(spark, change, stamp, queued):
    stored = posting(spark, posting_row(7, external_id="123", embedding_queued_at=stamp,
                                        status="stale", missed_run_count=50))
    rows, counts, _ = run(spark, stored, [batch_row(**change)])
    row = rows["adzuna", "123"]
    assert counts == (0, 1, queued, 0)
    assert (row.id, row.first_seen_at, row.last_seen_at, row.status, row.missed_run_count) == (
        7, NOW, LATER, "active", 0)
    assert row.embedding_queued_at == stamp
    for column, value in change.items():
        assert row[column] == value


def test_copies_in_one_batch(spark):
    """The last copy wins; every further copy counts as an update; a change back still counts."""
    stored = posting(spark, posting_row(7, external_id="123"))
    rows, counts, _ = run(spark, stored, [
        batch_row(title="Edited"), batch_row(), batch_row(external_id="9"), batch_row(external_id="9", company="B")])
    assert counts == (1, 3, 2, 0)
    assert rows["adzuna", "123"].title == "PHP Developer" and rows["adzuna", "123"].to_embed
    assert rows["adzuna", "9"].company == "B"


def test_ids_rise_in_batch_order(spark):
    stored = posting(spark, posting_row(40))
    fresh = [batch_row(external_id=f"n{i}") for i in range(20)]
    rows, _, _ = run(spark, stored, fresh)
    ids = [rows["adzuna", f"n{i}"].id for i in range(20)]
    assert ids == sorted(set(ids)) and ids[0] > 40


def test_upsert_is_idempotent(spark):
    stored = posting(spark, posting_row(1), posting_row(2, source="dou"))
    rows = [batch_row(external_id="1", title="x"), batch_row(external_id="5")]
    _, _, once = run(spark, stored, rows, "adzuna")
    _, counts, twice = run(spark, once, rows, "adzuna")
    assert sorted(once.collect()) == sorted(twice.collect())
    assert counts[0] == 0 and counts[3] == 0


def test_empty_seen_set_misses_every_row_of_the_source(spark):
    stored = posting(spark, posting_row(1, missed_run_count=143, status="stale"), posting_row(2),
                     posting_row(3, source="dou"))
    rows, counts, after = run(spark, stored, [], "adzuna")
    assert counts == (0, 0, 0, 1)
    assert rows["adzuna", "1"].status == "removed"
    assert (rows["adzuna", "2"].missed_run_count, rows["adzuna", "2"].status) == (1, "active")
    assert rows["dou", "3"].missed_run_count == 0
    _, counts, _ = run(spark, after, [], "adzuna")
    assert counts[3] == 0  # already removed, not newly


def test_mark_missing_agrees_with_upsert(spark):
    stored = posting(spark, *[posting_row(i, missed_run_count=i * 20, status="stale") for i in range(1, 9)])
    seen = stored.filter("id % 3 = 0").select("external_id")
    marked = {r.id: (r.missed_run_count, r.status, r.newly_removed)
              for r in up.mark_missing(stored, "adzuna", seen).collect()}
    assert marked[3] == (60, "stale", False)
    assert marked[7] == (141, "stale", False) and marked[8] == (161, "removed", True)
    missing = {r.id for r in up.anti_join_missing(stored, "adzuna", seen).collect()}
    assert missing == {1, 2, 4, 5, 7, 8}


@pytest.mark.parametrize(("source", "missed", "status"), [
    ("adzuna", 47, "active"), ("adzuna", 48, "stale"), ("adzuna", 144, "removed"), ("justjoinit", 1, "active"),
    ("justjoinit", 2, "stale"), ("justjoinit", 5, "removed"), ("djinni", 12, "stale"), ("dou", 72, "removed"),
    ("unknown", 1, "stale"), ("unknown", 3, "removed"),
])
def test_thresholds(spark, source, missed, status):
    row = spark.range(1).select(up.posting_status(F.lit(source), F.lit(missed)).alias("s")).first()
    assert row.s == status


def test_streak_ignores_failed_runs_and_other_sources(spark):
    good = spark.createDataFrame([("a", r) for r in (1, 2, 4, 5)] + [("b", 1)], "source string, run int")
    seen = spark.createDataFrame(
        [("a", "x", 1), ("a", "x", 3), ("a", "y", 5), ("b", "z", 1)], "source string, external_id string, run int")
    got = {r.external_id: r.missed_run_count for r in up.missed_run_streak(good, seen).collect()}
    assert got == {"x": 3, "y": 0, "z": 0}  # run 3 failed: neither a sighting nor a miss


def test_streak_equals_replayed_counting(spark):
    """The set-based streak equals run after run of miss counting."""
    import random
    rng = random.Random(3)
    runs = [set(rng.sample(range(10), rng.randint(0, 8))) for _ in range(12)]
    counts: dict[int, int] = {}
    for seen in runs:
        for i in counts:
            counts[i] = 0 if i in seen else counts[i] + 1
        counts.update({i: 0 for i in seen})
    good = spark.createDataFrame([("a", r) for r in range(12)], "source string, run int")
    sightings = spark.createDataFrame(
        [("a", str(i), r) for r, seen in enumerate(runs) for i in seen], "source string, external_id string, run int")
    got = {int(r.external_id): r.missed_run_count for r in up.missed_run_streak(good, sightings).collect()}
    assert got == counts


def test_mark_queued(spark):
    stored = posting(spark, posting_row(1, embedding_queued_at=None), posting_row(2, embedding_queued_at=None))
    confirmed = spark.createDataFrame([(2,), (2,), (99,)], "vacancy_id bigint")
    got = {r.id: r.embedding_queued_at for r in up.mark_queued(stored, confirmed, F.lit(LATER)).collect()}
    assert got == {1: None, 2: LATER}


def test_cleanup(spark):
    old, young = NOW - dt.timedelta(days=120), NOW - dt.timedelta(days=5)
    stored = posting(
        spark, posting_row(1, status="removed", first_seen_at=old), posting_row(2, first_seen_at=old),
        posting_row(3, status="removed", first_seen_at=young), posting_row(4, status="removed", first_seen_at=old),
        posting_row(5, status="removed", first_seen_at=old))
    artifact = spark.createDataFrame([(5,), (5,)], "vacancy_id bigint")
    candidates = up.cleanup_candidates(stored, application(spark, (4, "saved")), artifact, F.lit(NOW))
    assert {r.id: r.deletable for r in candidates.collect()} == {1: True, 4: False, 5: False}
    assert tuple(up.cleanup_summary(candidates).first()) == (3, 1, 2)
    index = spark.createDataFrame([(1,), (4,)], "vacancy_id bigint")
    left, left_index = up.delete_postings(stored, index, candidates)
    assert {r.id for r in left.collect()} == {2, 3, 4, 5}
    assert {r.vacancy_id for r in left_index.collect()} == {4}


def test_bucketed_store_is_not_shuffled_by_the_upsert(spark):
    stored = posting(spark, *[posting_row(i) for i in range(50)])
    write_bucketed(stored, "posting_v1", ["source", "external_id"], 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "true")
    try:
        fresh = batch(spark, batch_row(external_id="3"))

        def plan_of(frame):
            return frame._jdf.queryExecution().executedPlan().toString()

        result = up.upsert_postings(spark.table("posting_v1"), fresh, F.lit(LATER), "adzuna")
        plan = plan_of(result)
        exchange = "Exchange hashpartitioning(source"
        plain = plan_of(up.upsert_postings(stored, fresh, F.lit(LATER), "adzuna"))
        of_the_batch = plan_of(up.fold_batch(fresh)).count(exchange) + 1
        assert plan.count(exchange) == of_the_batch == plain.count(exchange) - 1
        assert "SortAggregate" not in plan
        assert "SelectedBucketsCount: 4 out of 4" in plan
        assert result.count() == 50
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
        spark.sql("DROP TABLE posting_v1")


def test_a_row_never_stamped_is_missed_like_any_other(spark):
    stored = posting(spark, posting_row(1, source="other", last_seen_at=None, missed_run_count=2),
                     posting_row(2, source="other"), posting_row(3, source="dou", last_seen_at=None))
    got = {r.id: (r.status, r.missed_run_count) for r in finish_run(stored, "other", F.lit(NOW)).collect()}
    assert got == {1: ("removed", 3), 2: ("active", 0), 3: ("active", 0)}
