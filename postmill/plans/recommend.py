"""The flagship job: ranked recommendations for one profile."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..constants import FRESH_DAYS, MAX_SHORTLIST, MAX_TOP_K, SENIORITY_LEVELS
from ..functions.text import norm_company
from ..functions.values import days_before, display_score
from ..functions.verdict import parse_verdict
from ..operators.feedback import decision_summary, with_adjustment
from ..operators.filters import not_hidden
from ..operators.knn import knn_topk
from ..sources.tables import one_of


@dataclass(frozen=True)
class Request:
    """What a caller asks for. ``freshness`` is 'last_seen' or 'status'."""

    as_of: Column
    top_k: int = 20
    min_score: int = 0
    sources: Sequence[str] | None = None
    fresh_days: int = FRESH_DAYS
    freshness: str = "last_seen"


def _bounded(rows: DataFrame) -> list[Row]:
    """The rows of a hit list, at most ``MAX_TOP_K``; more than that is refused."""
    found = rows.limit(MAX_TOP_K + 1).collect()
    if len(found) > MAX_TOP_K:
        raise ValueError(f"a hit list has at most {MAX_TOP_K} rows")
    return found


def pin_hits(hits: DataFrame) -> DataFrame:
    """Fix the at most 100 hits as constants.

    Only then can their ids reach the Parquet scans of the big tables as an IN
    filter. On tables sorted by id (``write_by_id``) it skips all row groups without a hit.
    """
    return hits.sparkSession.createDataFrame(_bounded(hits), hits.schema)


def hit_ids(hits: DataFrame) -> list[int]:
    return [row.vacancy_id for row in _bounded(hits.select("vacancy_id"))]


def join_hits_posting(hits: DataFrame, posting: DataFrame) -> DataFrame:
    """Pinned hits with their posting row; a hit without one is dropped."""
    rows = posting.filter(one_of("id", hit_ids(hits)))
    return rows.join(F.broadcast(hits.select("vacancy_id", "raw")), F.col("id") == F.col("vacancy_id"))


def join_hits_application(hits: DataFrame, application: DataFrame) -> DataFrame:
    """Add ``application_status`` to pinned hits (NULL for untracked ones)."""
    state = application.filter(one_of("vacancy_id", hit_ids(hits))).select(
        "vacancy_id", F.col("status").alias("application_status"))
    return hits.join(state, "vacancy_id", "left")


def resort_stable(df: DataFrame) -> DataFrame:
    """Adjusted score first; ties keep the raw order."""
    return df.orderBy(F.col("score").desc(), F.col("raw").desc(), F.col("vacancy_id"))


def recommend(
    posting: DataFrame, application: DataFrame, index: DataFrame, query: Sequence[float],
    skills: Sequence[str], request: Request, levels: Sequence[str] = SENIORITY_LEVELS,
) -> DataFrame:
    """kNN, then joins, four filters, feedback, clamp, re-sort and the score floor.

    ``top_k`` cuts before the filters, so fewer rows may return; a hit without a posting
    counts against it and drops out. Postings are read three times: the hits' companies,
    one aggregate over all decisions, the result. What comes to the driver while the plan is
    built is bounded by ``top_k``, the skills and the levels. Title, company and URL are the
    posting's present ones, not those the index stored.
    """
    vectors = index.select("vacancy_id", "source", "embedding")
    hits = pin_hits(knn_topk(vectors, query, request.top_k, request.sources).drop("source"))
    wanted = hit_ids(hits)
    found = posting.filter(one_of("id", wanted)).withColumn(
        "company_key", norm_company(F.col("company")))
    # As few as the hits: only their companies are asked about.
    companies = [r[0] for r in found.select("company_key").distinct().collect() if r[0]]
    signals, excluded = decision_summary(posting, application, skills, companies, levels)
    if request.freshness == "status":
        found = found.filter(F.coalesce("status", F.lit("active")) == "active")
    else:
        found = found.filter(F.col("last_seen_at") >= days_before(request.as_of, request.fresh_days))
    state = application.filter(one_of("vacancy_id", wanted)).select(
        "vacancy_id", F.col("status").alias("application_status"))
    candidates = (
        found.filter(F.coalesce(~F.col("company_key").isin(excluded), F.lit(True)))
        .join(F.broadcast(hits), F.col("id") == F.col("vacancy_id"))
        .join(state, "vacancy_id", "left")
        .filter(not_hidden(F.col("application_status")))
    )
    scored = with_adjustment(candidates, signals, skills, levels).withColumn(
        "score", display_score(F.col("raw"), F.col("adjustment")))
    return resort_stable(
        scored.filter(F.col("score") >= request.min_score).select(
            "vacancy_id", "source", "title", "company", "url", "raw", "adjustment", "score",
            "application_status"))


def shortlist(ranked: DataFrame, n: int) -> DataFrame:
    """First rows of a ranking (at most ten), with their position."""
    if not 0 <= n <= MAX_SHORTLIST:
        raise ValueError(f"shortlist size must be between 0 and {MAX_SHORTLIST}")
    order = F.struct(-F.col("score"), -F.col("raw"), F.col("vacancy_id"))
    rows = resort_stable(ranked).limit(n)
    ranks = rows.agg(F.array_sort(F.collect_list(order)).alias("o")).scalar()
    return rows.withColumn("position", F.array_position(ranks, order))


def rerank_with_scores(short: DataFrame, responses: DataFrame) -> DataFrame:
    """Replace the list by the shortlisted rows that got a valid verdict, best first."""
    verdicts = responses.select(
        "vacancy_id", parse_verdict(F.col("returncode"), F.col("timed_out"), F.col("stdout")).alias("v")
    ).filter("v.outcome = 'success'")
    return (
        short.drop("score").join(verdicts, "vacancy_id")
        .select(*[c for c in short.columns if c != "score"], F.col("v.score").alias("score"),
                F.col("v.reasoning").alias("reasoning"), F.col("v.concerns").alias("concerns"))
        .orderBy(F.col("score").desc(), F.col("position"))
    )
