import datetime as dt

import pytest
from helpers import NOW, application, posting, posting_row
from postmill.operators import filters as fl
from postmill.operators import metrics as mt
from postmill.operators import tracking as tr
from postmill.sources.profile import count_children, list_children
from pyspark.sql import functions as F


def updates(spark, *rows):
    """(status, notes or ..., follow_up or ...): ``...`` means the field was not named."""
    def cells(i, status, notes, day):
        return (i, 1, status, None if notes is ... else notes, notes is not ...,
                None if day is ... else day, day is not ..., NOW + dt.timedelta(seconds=i))
    return spark.createDataFrame(
        [cells(i, *r) for i, r in enumerate(rows)],
        "id bigint, vacancy_id bigint, status string, notes string, notes_set boolean, follow_up_at date, "
        "follow_up_set boolean, created_at timestamp")


DAY = dt.date(2026, 4, 1)


def test_partial_update(spark):
    log = updates(spark, ("saved", "call", DAY), ("applied", ..., ...))
    row = tr.fold_updates(log).first()
    assert (row.status, row.notes, row.follow_up_at) == ("applied", "call", DAY)
    log = updates(spark, ("saved", "call", DAY), ("applied", "", None), ("applied", ..., ...))
    row = tr.fold_updates(log).first()
    assert (row.notes, row.follow_up_at, row.created_at, row.updated_at) == (
        "", None, NOW, NOW + dt.timedelta(seconds=2))
    row = tr.fold_updates(updates(spark, ("saved", ..., ...))).first()
    assert (row.notes, row.follow_up_at) == ("", None)


def test_events_only_on_change(spark):
    log = updates(spark, ("saved", "n", ...), ("saved", "other", ...), ("applied", ..., ...), ("unknown", ..., ...),
                  ("applied", "x", ...), ("saved", ..., ...))
    events = tr.append_events(log).orderBy("id").collect()
    assert [(e.status, e.note) for e in events] == [("saved", "n"), ("applied", ""), ("saved", "")]
    good, bad = fl.validate_enum(log, "status", ("saved", "applied"))
    assert (good.count(), bad.count()) == (5, 1)


def test_current_status_is_by_id(spark):
    log = spark.createDataFrame([(2, 1, "offer"), (1, 1, "saved"), (3, 2, "saved")], "id bigint, application_id bigint, status string")
    assert {r.application_id: r.status for r in tr.current_status(log).collect()} == {1: "offer", 2: "saved"}


def artifacts(spark, stored):
    made = spark.createDataFrame(
        [(1, 1, "cover_letter", "a"), (2, 1, "tailoring_suggestions", "b"), (3, 2, "poem", "c"), (4, 99, "cover_letter", "d")],
        "id bigint, vacancy_id bigint, artifact_type string, content string")
    return tr.append_artifact(made, stored, F.lit(NOW))


def test_artifact_snapshot_outlives_edits(spark, tmp_path):
    stored = posting(spark, posting_row(1, title="Old"), posting_row(2))
    artifacts(spark, stored).write.parquet(str(tmp_path / "a"))
    saved = spark.read.parquet(str(tmp_path / "a"))
    assert {r.id: r.vacancy_title for r in saved.collect()} == {1: "Old", 2: "Old"}
    plan = tr.artifact_summary(saved)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_pipeline(spark):
    stored = posting(spark, posting_row(1), posting_row(2))
    state = application(spark, (1, "applied"), (2, "saved"), (77, "saved")).withColumns({
        "notes": F.lit(""), "follow_up_at": F.lit(None).cast("date"), "updated_at": F.lit(NOW)})
    rows = {r.vacancy_id: r for r in tr.join_pipeline(stored, state, artifacts(spark, stored)).collect()}
    assert set(rows) == {1, 2}  # the orphan is gone
    assert (rows[1].n_artifacts, rows[1].newest_id) == (2, 2)
    assert (rows[2].n_artifacts, rows[2].newest_id) == (0, None)
    listed = tr.artifact_list(artifacts(spark, stored)).collect()
    assert sorted((r.position, r.id) for r in listed if r.vacancy_id == 1) == [(0, 2), (1, 1)]
    counts = [(r.status, r.n) for r in tr.pipeline_counts(state, stored).collect()]
    assert counts == [("saved", 1), ("applied", 1), (None, 2)]


def test_one_row_per_key_however_many_children(spark):
    many = spark.range(10_001).select(
        "id", F.lit(1).cast("bigint").alias("vacancy_id"), F.lit("cover_letter").alias("artifact_type"),
        F.lit("text").alias("content"), F.lit(NOW).alias("created_at"))
    assert tr.artifacts_by_posting(many).collect() == [(1, 10_001, 10_000)]
    state = application(spark, (1, "applied")).withColumns({
        "notes": F.lit(""), "follow_up_at": F.lit(None).cast("date"), "updated_at": F.lit(NOW)})
    rows = tr.join_pipeline(posting(spark, posting_row(1)), state, many).collect()
    assert [(r.vacancy_id, r.n_artifacts) for r in rows] == [(1, 10_001)]
    children = many.withColumnRenamed("vacancy_id", "profile_id")
    profile = spark.createDataFrame([(1,), (2,)], "id bigint")
    counted = count_children(profile, {"skills": children, "jobs": children.limit(3)}).collect()
    assert sorted(map(tuple, counted)) == [(1, 10_001, 3), (2, 0, 0)]
    listed = list_children({"skills": (children, F.col("artifact_type"))})
    assert listed.count() == listed.select("position").distinct().count() == 10_001


def test_run_log(spark):
    starts = spark.createDataFrame([(1, "a", NOW), (2, "a", NOW), (3, "b", NOW)], "run_id bigint, source string, started_at timestamp")
    later = NOW + dt.timedelta(minutes=1)
    finishes = spark.createDataFrame(
        [(1, 0, later, 5, 2, 3, None), (2, 1, later, None, None, None, "x" * 3000), (9, 2, later, 1, 1, 0, None)],
        "run_id bigint, seq bigint, finished_at timestamp, fetched_count int, new_count int, updated_count int, error string")
    runs = tr.run_log(starts, finishes)
    got = {r.run_id: (r.state, len(r.error or "")) for r in runs.collect()}
    assert got == {1: ("ok", 0), 2: ("failed", 2000), 3: ("running", 0)}
    assert [r.run_id for r in tr.unknown_finishes(starts, finishes).collect()] == [9]
    named = runs.withColumnRenamed("run_id", "id")
    assert [r.id for r in fl.filter_runs(named, limit=2).collect()] == [3, 2]
    assert [r.id for r in fl.filter_runs(named, "a").collect()] == [2, 1]
    assert [(r.id, r.state) for r in tr.newest_runs(starts, finishes, limit=2).collect()] == [
        (3, "running"), (2, "failed")]
    assert [r.id for r in tr.newest_runs(starts, finishes, "a").collect()] == [2, 1]
    for limit in (0, 201):
        with pytest.raises(ValueError, match="limit"):
            fl.filter_runs(named, limit=limit)


def test_run_log_by_run(spark, monkeypatch):
    """Tasks follow the number of runs, whatever their texts come to when compressed."""
    monkeypatch.setattr(tr, "RUNS_PER_TASK", 10)
    starts = spark.createDataFrame([(i, "a", NOW) for i in range(95)], "run_id bigint, source string, started_at timestamp")
    rows = spark.range(400).select((F.col("id") % 100).alias("run_id"), F.floor(F.col("id") / 100).alias("seq"))
    dealt, lines = tr.by_run(starts, rows, "run_id")

    def texts(lines):
        return lines.select(
            "run_id", "seq", F.lit(NOW).alias("finished_at"), *[F.lit(1).alias(f"{n}_count") for n in ("fetched", "new", "updated")],
            F.when(F.col("run_id") % 2 == 0, F.rpad(F.lit("e"), 2500, "x")).alias("error"))

    runs = tr.run_log(dealt, texts(lines).hint("merge"))
    assert runs.rdd.getNumPartitions() == 10
    assert sorted(runs.collect()) == sorted(tr.run_log(starts, texts(rows)).collect())
    assert runs._jdf.queryExecution().toString().count("rpad") >= 1
    assert all("rpad" not in line and "error" not in line for line in
               runs._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line)


def test_filters(spark):
    stored = posting(spark, posting_row(1, title="PHP", tags=["web"]), posting_row(2, source="dou", description="Symfony"))
    def ids(df):
        return {r.id for r in df.collect()}
    assert ids(fl.filter_keywords(stored, ["symFONY", "absent"])) == {2}
    assert ids(fl.filter_keywords(stored, [])) == {1, 2}
    assert ids(fl.filter_keywords(stored, [], when_empty=False)) == set()
    assert ids(fl.filter_keywords(stored, ["web"], ["dou"])) == set()
    decided = application(spark, (1, "dismissed"), (2, "saved"))
    assert ids(fl.filter_hidden(stored, decided)) == {2}
    rows = decided.withColumn("updated_at", F.lit(NOW))
    assert [r.id for r in fl.filter_applications(rows).collect()] == [2, 1]


def test_quantile_interpolates_like_a_histogram(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in range(1, 101)] + [("b", 200.0)], "k string, v double")
    got = {r.k: r.quantile for r in mt.quantile_p95(rows, "v", ["k"]).collect()}
    assert got == {"a": 90.0, "b": 90.0}  # both fall into the open bucket
    low = spark.createDataFrame([("a", 0.5)] * 19 + [("a", 2.0)], "k string, v double")
    assert mt.quantile_p95(low, "v", ["k"]).first().quantile == 1.0
    steps = mt.duration_histogram(low, "v", ["k"]).collect()
    assert {r.le: r.cumulative for r in steps}["2.5"] == 20 and len(steps) == 12


def test_sliding_latency_forms_agree(spark):
    start = dt.datetime(2026, 1, 1)
    rows = spark.createDataFrame(
        [(start + dt.timedelta(seconds=37 * i), "ab"[i % 2], float(i % 70)) for i in range(200)], "ts timestamp, k string, v double")
    def keyed(df):
        return {(r.window_start, r.k): (r.n, round(r.quantile, 9)) for r in df.collect()}
    assert keyed(mt.latency_quantile(rows, "ts", "v", ["k"])) == keyed(mt.latency_quantile_paned(rows, "ts", "v", ["k"]))
