"""Predicates and projections over postings, applications and runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import FRESH_DAYS, NEGATIVE_STATUSES
from ..functions.text import any_keyword, haystack, norm_company
from ..functions.values import (
    days_before, monthly_salary, salary_label, score_band,
)

#: Copies of a short list of keys, so that the rows of one large key meet it in several tasks.
SALTS = 16


def filter_sources(df: DataFrame, sources: Sequence[str] | None) -> DataFrame:
    """``source IN (...)``; none means all. Prunes partitions of a source-partitioned table."""
    return df.filter(F.col("source").isin(list(sources))) if sources else df


def filter_keywords(
    df: DataFrame, keywords: Sequence[str], sources: Sequence[str] | None = None,
    when_empty: bool = True,
) -> DataFrame:
    """Any-of substring match over title, description and tags.

    An empty list matches everything in the stored query (``when_empty``) and
    nothing at the JSON scan.
    """
    text = haystack(F.col("title"), F.col("description"), F.col("tags"), ",")
    return filter_sources(df, sources).filter(any_keyword(text, keywords, when_empty))


def filter_url_slug(df: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """The same test on the URL alone, placed before the costly page step."""
    return df.filter(any_keyword(F.lower("url"), keywords, False))


def filter_fresh(df: DataFrame, as_of: Column, days: int = FRESH_DAYS) -> DataFrame:
    return df.filter(F.col("last_seen_at") >= days_before(as_of, days))


def not_hidden(status: Column) -> Column:
    """Untracked postings stay, dismissed and rejected ones go."""
    return F.coalesce(~status.isin(*NEGATIVE_STATUSES), F.lit(True))


def filter_hidden(posting: DataFrame, application: DataFrame) -> DataFrame:
    hidden = application.filter(F.col("status").isin(*NEGATIVE_STATUSES)).select(
        F.col("vacancy_id").alias("id"))
    return posting.join(hidden, "id", "left_anti")


def filter_excluded_company(posting: DataFrame, excluded: DataFrame) -> DataFrame:
    """Drop postings of excluded companies; ``excluded(company_key)`` holds normalised names.

    Where Spark does not broadcast the names, each stands in ``SALTS`` partitions, so the
    postings of one large company are not one task's work.
    """
    names = excluded.select("company_key").distinct().withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (
        posting.withColumn("company_key", norm_company(F.col("company")))
        .withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
        .join(names, ["company_key", "_salt"], "left_anti")
        .drop("company_key", "_salt")
    )


def filter_applications(application: DataFrame, statuses: Sequence[str] | None = None) -> DataFrame:
    """Applications of the given statuses, newest first."""
    kept = application.filter(F.col("status").isin(list(statuses))) if statuses else application
    return kept.orderBy(F.col("updated_at").desc(), F.col("id").desc())


def run_state(finished_at: Column, error: Column) -> Column:
    return (
        F.when(finished_at.isNull(), F.lit("running"))
        .when(error.isNotNull(), F.lit("failed"))
        .otherwise(F.lit("ok"))
    )


def check_run_limit(limit: int) -> None:
    if not 1 <= limit <= 200:
        raise ValueError("limit must be between 1 and 200")


def filter_runs(runs: DataFrame, source: str | None = None, limit: int = 50) -> DataFrame:
    """The newest runs; ids decide, since start times may tie."""
    check_run_limit(limit)
    kept = runs.filter(F.col("source") == source) if source else runs
    return (
        kept.withColumn("state", run_state(F.col("finished_at"), F.col("error")))
        .orderBy(F.col("id").desc())
        .limit(limit)
    )


def validate_enum(df: DataFrame, column: str, allowed: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Valid rows and the quarantine; NULL is not valid."""
    good = F.coalesce(F.col(column).isin(list(allowed)), F.lit(False))
    return df.filter(good), df.filter(~good)


def top_recent(df: DataFrame, limit: int, order: str = "id") -> DataFrame:
    return df.orderBy(F.col(order).desc()).limit(limit)


def posting_card(df: DataFrame) -> DataFrame:
    """Result card columns: salary label, monthly figures and score band."""
    monthly = monthly_salary(F.col("salary_min"), F.col("salary_max"), F.col("salary_period"))
    return (
        df.withColumn("_monthly", monthly)
        .select(
            "*",
            salary_label(
                F.col("salary_min"), F.col("salary_max"), F.col("salary_currency"),
                F.col("salary_period"), F.col("salary_is_predicted")).alias("salary_label"),
            F.col("_monthly.low").alias("monthly_min"),
            F.col("_monthly.high").alias("monthly_max"),
            score_band(F.col("score")).alias("band"),
        )
        .drop("_monthly")
    )
