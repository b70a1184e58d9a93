"""The profile: one nested document per person, or a parent with child tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import clean_text, iso_date
from ..operators.ordered import number_rows
from ..schemas import PROFILE, PROFILE_FILE, ddl

_TEXTS = (
    "location", "email", "phone", "linkedin_url", "github_url", "summary", "languages",
)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ddl(PROFILE_FILE)).option("multiLine", True).json(path)


def _dated(entries: str, fields: tuple[str, ...], default: str) -> Column:
    def one(e: Column) -> Column:
        return F.struct(*[
            (iso_date(e[f]) if f.endswith("_date") else clean_text(e[f])).alias(f) for f in fields])

    return F.coalesce(F.transform(entries, one), F.array().cast(default))


def _bad_dates(entries: str) -> Column:
    def bad(text: Column) -> Column:
        return (clean_text(text) != "") & iso_date(text).isNull()

    return F.coalesce(
        F.exists(entries, lambda e: bad(e["start_date"]) | bad(e["end_date"])), F.lit(False))


def scan_profile(documents: DataFrame, profile_id: Column) -> tuple[DataFrame, DataFrame]:
    """``(profiles, quarantine)``: ISO dates parsed, absent texts and lists empty."""
    broken = _bad_dates("experiences") | _bad_dates("educations") | F.col("full_name").isNull()
    marked = documents.withColumn("id", profile_id).withColumn("_broken", broken)
    good = marked.filter(~F.col("_broken")).select(
        F.col("id").cast("bigint"),
        "full_name",
        *[clean_text(F.col(c)).alias(c) for c in _TEXTS],
        F.coalesce("skills", F.array().cast(PROFILE["skills"])).alias("skills"),
        _dated("experiences",
               ("title", "company", "location", "start_date", "end_date", "highlights"),
               PROFILE["experiences"]).alias("experiences"),
        _dated("educations", ("institution", "degree", "field", "start_date", "end_date"),
               PROFILE["educations"]).alias("educations"),
    )
    return good, marked.filter("_broken").drop("_broken")


def replace_profile(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Profiles after a reload: parents updated in place, children replaced as a whole.

    One write of the result is one atomic step, since children live in the row.
    """
    kept = stored.join(fresh.select("id"), "id", "left_anti")
    return kept.unionByName(fresh.select(*PROFILE))


def first_profile(profiles: DataFrame) -> DataFrame:
    """The profile with the lowest id."""
    return profiles.orderBy("id").limit(1)


def count_children(profile: DataFrame, children: Mapping[str, DataFrame]) -> DataFrame:
    """Profile with the number of rows of each child table, one row per profile.

    Each child is aggregated before the join; joining raw children side by side would
    multiply them.
    """
    rows = profile.withColumnRenamed("id", "profile_id")
    for name, table in children.items():
        counts = table.groupBy("profile_id").agg(F.count(F.lit(1)).alias(f"n_{name}"))
        rows = rows.join(counts, "profile_id", "left").withColumn(
            f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)))
    return rows


def list_children(children: Mapping[str, tuple[DataFrame, Column]]) -> DataFrame:
    """All children in order: ``profile_id, child, position, item``.

    ``children`` maps a name to ``(table with profile_id and id, item)``.
    """
    lists = [
        number_rows(table, ["profile_id"], "id").select(
            "profile_id", F.lit(name).alias("child"), "position", item.alias("item"))
        for name, (table, item) in children.items()]
    return reduce(DataFrame.unionByName, lists)


def append_resume_version(profiles: DataFrame, label: str, as_of: Column) -> DataFrame:
    """A labelled snapshot row per profile, the whole profile as JSON text."""
    fields = list(PROFILE)
    return profiles.select(
        F.col("id").alias("profile_id"), F.lit(label).alias("label"),
        F.to_json(F.struct(*fields)).alias("content"), as_of.alias("created_at"))
