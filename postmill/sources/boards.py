"""The five boards in the registry: landed folders in, rows of the shared schema out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import filter_url_slug
from ..plans.ingest import ingest_run
from . import feeds, normalize, pages

#: A landed page with the address it came from.
PAGE = "url string, html string, status int"


def _adzuna(spark: SparkSession, folder: str, keywords: Sequence[str], location: str) -> DataFrame:
    """Search pages of one country; the search itself applied the keywords."""
    return feeds.scan_json_jobs(feeds.read_json_pages(spark, folder), F.lit(location))


def _arbeitnow(spark: SparkSession, folder: str, keywords: Sequence[str], location: str) -> DataFrame:
    return feeds.scan_json_jobs_tagged(feeds.read_tagged_pages(spark, folder), keywords)


def _dou(spark: SparkSession, folder: str, keywords: Sequence[str], location: str) -> DataFrame:
    return feeds.scan_rss_items(feeds.read_rss(spark, folder))


def _djinni(spark: SparkSession, folder: str, keywords: Sequence[str], location: str) -> DataFrame:
    """Posting pages found through the board's own listing; unreadable ones stay out."""
    return pages.jobposting_to_job(pages.extract_jsonld(spark.read.schema(PAGE).parquet(folder)))[0]


def _justjoinit(spark: SparkSession, folder: str, keywords: Sequence[str], location: str) -> DataFrame:
    """Posting pages found through the sitemap: the address is all there is to choose by."""
    chosen = filter_url_slug(spark.read.schema(PAGE).parquet(folder), keywords)
    blocks = pages.extract_jsonld(chosen, fall_back_to_first=True)
    return pages.jobposting_to_job(blocks, id_from_block_url=False)[0]


for _name, _read in (
    ("adzuna", _adzuna), ("arbeitnow", _arbeitnow), ("justjoinit", _justjoinit), ("dou", _dou),
    ("djinni", _djinni),
):
    normalize.register_source(_name, _read, normalize.NORMALIZERS[_name])


def ingest_board(
    spark: SparkSession, root: str, run_id: int, source: str, landing: str, as_of: Column,
    keywords: Sequence[str] = (), location: str = "",
) -> dict[str, int]:
    """One run of a registered board, from ``landing/source`` to its next version below ``root``."""
    return ingest_run(
        spark, root, run_id, source,
        lambda: normalize.fetch(source, spark, f"{landing}/{source}", keywords, location),
        as_of, ",".join(keywords), location)
