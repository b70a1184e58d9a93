"""Landed JSON, RSS and sitemap payloads to job rows.

Each board has a reader for landed files (``read_*``) and a parser that works on
the resulting columns or on a text column of payloads. Readers carry an explicit
schema, so Spark reads only the fields asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import FEED_ID_PATTERN
from ..functions.html import unescape_entities
from ..functions.packed_title import parse_packed_title
from ..functions.text import any_keyword, once
from ..functions.urls import id_in_url, without_query
from ..functions.values import clean_text, country_currency, rfc2822_to_epoch
from ..schemas import JSON_PAGE, JSON_TAGGED_PAGE, RSS_ITEM, SITEMAP_ENTRY, ddl

_XML = {"mode": "PERMISSIVE", "ignoreSurroundingSpaces": "false"}


def from_payload(payloads: DataFrame, schema: dict[str, str], column: str = "payload") -> DataFrame:
    """Parse a text column of JSON documents into ``schema`` columns; the rest is kept."""
    rest = [c for c in payloads.columns if c != column]
    parsed = once(payloads, "_doc", F.from_json(column, ddl(schema)))
    return parsed.select(*rest, "_doc.*")


def read_json_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ddl(JSON_PAGE)).option("multiLine", True).json(path)


def scan_json_jobs(pages: DataFrame, country: Column) -> DataFrame:
    """``results[]`` of search pages. Yearly salaries, currency implied by the country."""
    job = F.col("job")
    jobs = pages.select(F.explode_outer("results").alias("job"), country.alias("_country"))
    return jobs.filter(job.isNotNull()).select(
        job["id"].alias("external_id"),
        clean_text(job["title"]).alias("title"),
        clean_text(job["company"]["display_name"]).alias("company"),
        clean_text(job["location"]["display_name"]).alias("location"),
        clean_text(job["redirect_url"]).alias("url"),
        clean_text(job["description"]).alias("description"),
        clean_text(job["category"]["label"]).alias("category"),
        job["created"].try_cast("timestamp").alias("created_at"),
        job["salary_min"].alias("salary_min"),
        job["salary_max"].alias("salary_max"),
        country_currency(F.col("_country")).alias("salary_currency"),
        F.lit("year").alias("salary_period"),
        (F.coalesce(job["salary_is_predicted"], F.lit("")) == "1").alias("salary_is_predicted"),
    )


def read_tagged_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ddl(JSON_TAGGED_PAGE)).option("multiLine", True).json(path)


def scan_json_jobs_tagged(pages: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """``data[]`` of tagged pages, keyword-filtered at the scan (no keyword, no rows)."""
    job = F.col("job")
    no_tags = F.array().cast("array<string>")
    text = F.lower(F.concat_ws(
        " ", clean_text(job["title"]), clean_text(job["description"]),
        F.array_join(F.coalesce(job["tags"], no_tags), " ")))
    return (
        pages.select(F.explode_outer("data").alias("job"))
        .filter(job.isNotNull())
        .filter(any_keyword(text, keywords, when_empty=False))
        .select(
            job["slug"].alias("external_id"),
            job["title"].alias("title"),
            job["company_name"].alias("company"),
            clean_text(job["location"]).alias("location"),
            F.coalesce(job["remote"], F.lit(False)).alias("remote"),
            job["url"].alias("url"),
            clean_text(job["description"]).alias("description"),
            F.coalesce(job["tags"], no_tags).alias("tags"),
            job["created_at"].alias("created_epoch"),
        )
    )


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").options(rowTag="item", **_XML).schema(ddl(RSS_ITEM)).load(path)


def rss_items(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """A text column holding one ``<item>`` each."""
    rest = [c for c in payloads.columns if c != column]
    parsed = F.from_xml(F.col(column), ddl(RSS_ITEM), {**_XML, "rowTag": "item"})
    return once(payloads, "_item", parsed).select(*rest, "_item.*")


def scan_rss_items(items: DataFrame) -> DataFrame:
    """Feed items to job rows; items without link, title or numeric id are dropped."""
    titled = (
        items.filter((F.coalesce("link", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != ""))
        .withColumn("url", without_query(F.col("link")))
        .withColumn("external_id", id_in_url(F.col("url"), FEED_ID_PATTERN))
        .filter(F.col("external_id").isNotNull())
    )
    return (
        once(titled, "_t", parse_packed_title(unescape_entities(F.col("title"))))
        .select(
            "external_id", "_t.title", "_t.company", "_t.location", "_t.remote", "url",
            clean_text(F.col("description")).alias("description"),
            rfc2822_to_epoch(F.col("pubDate")).alias("created_epoch"),
            "_t.salary_min", "_t.salary_max", "_t.salary_currency",
        )
    )


def read_sitemap(spark: SparkSession, path: str, row_tag: str = "url") -> DataFrame:
    """``loc`` entries of landed sitemap files; ``row_tag`` is 'sitemap' for the index."""
    return (
        spark.read.format("xml").options(rowTag=row_tag, mode="PERMISSIVE").schema(ddl(SITEMAP_ENTRY))
        .load(path).filter("loc is not null")
    )


def scan_sitemap_urls(index: DataFrame, parts: DataFrame) -> DataFrame:
    """URLs of every part the index names.

    ``index(payload)`` holds sitemap index documents, ``parts(part_url, payload)``
    the part documents. A part the index does not name is not read.
    """
    def locations(tag: str) -> Column:
        schema = f"struct<{tag}:array<struct<loc:string>>>"
        return F.from_xml(F.col("payload"), schema, {"mode": "PERMISSIVE"})[tag]

    named = index.select(F.explode_outer(locations("sitemap")).alias("e")).select(
        F.col("e.loc").alias("part_url")).filter("part_url is not null")
    return (
        parts.join(named, "part_url", "left_semi")
        .select(F.explode_outer(locations("url")).alias("e"))
        .select(F.col("e.loc").alias("url"))
        .filter("url is not null")
    )
