"""Listing pages and posting pages with embedded JSON-LD."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    JSON_LD_PATTERN, LISTING_BASE_URL, LISTING_ID_PATTERN, LISTING_LINK_PATTERN,
)
from ..functions.text import let, once
from ..functions.urls import id_in_url, last_segment
from ..functions.values import clean_text, place, unit_period


def extract_listing_links(
    listing: DataFrame, pattern: str = LISTING_LINK_PATTERN, base_url: str = LISTING_BASE_URL,
) -> DataFrame:
    """Posting links per crawl, each once at its first place.

    ``listing(crawl, page, html, status, was_redirected)``. A page that failed, was
    redirected or holds no link ends its crawl: neither it nor anything after it
    counts. Both steps are aggregates, so a crawl of any length is fine.
    """
    bad = (F.col("status") != 200) | F.col("was_redirected")
    links = F.when(~bad, F.regexp_extract_all("html", F.lit(pattern), F.lit(1)))
    # A bad page explodes to one row without a path and marks its crawl's end. The
    # mark is an aggregate and the join null-safe, so nothing can be pushed into one
    # side only and both sides share one shuffle of one scan.
    first_places = (
        listing.select("crawl", "page", F.posexplode_outer(links).alias("pos", "path"))
        .groupBy("crawl", F.concat(F.lit(base_url), "path").alias("url"))
        .agg(F.min(F.struct("page", "pos")).alias("first"),
             F.bool_or(F.col("path").isNull()).alias("is_end"))
    )
    ends = first_places.filter("is_end").select(
        F.col("crawl").alias("ended"), F.col("first.page").alias("stop"))
    return (
        first_places.filter(~F.col("is_end"))
        .join(ends, F.col("crawl").eqNullSafe(F.col("ended")), "left")
        .filter(F.col("stop").isNull() | (F.col("first.page") < F.col("stop")))
        .select("crawl", "url", "first.page", "first.pos")
    )


def extract_jsonld(pages: DataFrame, fall_back_to_first: bool = False) -> DataFrame:
    """``(url, job)`` with the first JobPosting block of each page as VARIANT.

    One board uses the first block when none is a JobPosting
    (``fall_back_to_first``). A malformed block drops its page and no other.
    """
    def choose(docs: Column) -> Column:
        matching = F.filter(
            docs, lambda d: F.try_variant_get(d, "$['@type']", "string") == "JobPosting")
        job = F.try_element_at(matching, F.lit(1))
        if fall_back_to_first:
            job = F.coalesce(job, F.try_element_at(docs, F.lit(1)))
        return F.when(~F.exists(docs, lambda d: d.isNull()), job)

    blocks = F.regexp_extract_all("html", F.lit(JSON_LD_PATTERN), F.lit(1))
    job = let(F.transform(blocks, lambda b: F.try_parse_json(b)), choose)
    read = pages.filter(F.coalesce("status", F.lit(200)) == 200).select("url", "html")
    return once(read, "job", job).select("url", "job").filter("job is not null")


def _text(path: str) -> Column:
    return F.try_variant_get("job", path, "string")


def _locality() -> Column:
    """A string or a list of strings."""
    path = "$.jobLocation.address.addressLocality"
    listed = F.try_variant_get("job", path, "array<string>")
    return F.when(listed.isNotNull(), F.array_join(listed, ", ")).otherwise(_text(path))


def jobposting_to_job(blocks: DataFrame, id_from_block_url: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(jobs, quarantine)`` from JobPosting blocks.

    Explicit null and missing behave alike. With ``id_from_block_url`` the block's
    own URL wins and the id is the number in it; otherwise both come from the page
    URL. A row with an unreadable date or salary goes to quarantine.
    """
    url = F.coalesce(F.nullif(_text("$.url"), F.lit("")), F.col("url")) if id_from_block_url else F.col("url")
    if id_from_block_url:
        external_id = F.coalesce(
            id_in_url(url, LISTING_ID_PATTERN), id_in_url(F.col("url"), LISTING_ID_PATTERN),
            last_segment(url))
    else:
        external_id = last_segment(url)
    posted = _text("$.datePosted")
    low, high = "$.baseSalary.value.minValue", "$.baseSalary.value.maxValue"
    rows = blocks.select(
        external_id.alias("external_id"),
        clean_text(_text("$.title")).alias("title"),
        clean_text(_text("$.hiringOrganization.name")).alias("company"),
        place(_locality(), _text("$.jobLocation.address.addressCountry")).alias("location"),
        (F.coalesce(_text("$.jobLocationType"), F.lit("")) == "TELECOMMUTE").alias("remote"),
        url.alias("url"),
        clean_text(_text("$.description")).alias("description"),
        posted.try_cast("timestamp").alias("created_at"),
        F.try_variant_get("job", low, "double").alias("salary_min"),
        F.try_variant_get("job", high, "double").alias("salary_max"),
        clean_text(_text("$.baseSalary.currency")).alias("salary_currency"),
        unit_period(clean_text(_text("$.baseSalary.value.unitText"))).alias("salary_period"),
        posted.alias("_posted"), _text(low).alias("_low"), _text(high).alias("_high"),
    )
    broken = (
        (F.col("_posted").isNotNull() & F.col("created_at").isNull())
        | (F.col("_low").isNotNull() & F.col("salary_min").isNull())
        | (F.col("_high").isNotNull() & F.col("salary_max").isNull())
    )
    helper = ["_posted", "_low", "_high"]
    marked = once(rows, "_broken", F.coalesce(broken, F.lit(False)))
    return (
        marked.filter(~F.col("_broken")).drop("_broken", *helper),
        marked.filter("_broken").select("url", "external_id", *helper),
    )
