"""Small frames in the engine's schemas."""

from __future__ import annotations

import datetime as dt

from postmill.schemas import BATCH, POSTING, ddl

NOW = dt.datetime(2026, 3, 1, 12, 0, 0)


def batch_row(**over):
    row = {
        "source": "adzuna", "external_id": "123", "title": "PHP Developer", "company": "Acme",
        "location": "Warsaw", "remote": False, "url": "https://example.test/123",
        "description": "Original description.", "tags": [], "posted_at": None, "salary_min": None,
        "salary_max": None, "salary_currency": "", "salary_period": "", "salary_is_predicted": False,
    }
    return {**row, **over}


def posting_row(id_, **over):
    row = {
        **batch_row(external_id=str(id_), url=f"https://example.test/{id_}"), "id": id_,
        "first_seen_at": NOW, "last_seen_at": NOW, "status": "active", "missed_run_count": 0,
        "embedding_queued_at": NOW,
    }
    return {**row, **over}


def _frame(spark, rows, columns):
    return spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], ddl(columns))


def batch(spark, *rows):
    columns = {**BATCH, "ordinal": "bigint"}
    return _frame(spark, [{**r, "ordinal": i} for i, r in enumerate(rows)], columns)


def posting(spark, *rows):
    return _frame(spark, rows, POSTING)


def application(spark, *pairs):
    return spark.createDataFrame(
        [(i, vid, status) for i, (vid, status) in enumerate(pairs, 1)], "id bigint, vacancy_id bigint, status string")
