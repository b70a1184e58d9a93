"""Feed titles that pack company, salary, places and the remote word into one string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (
    REMOTE_WORD, SALARY_EXACT_PATTERN, SALARY_FROM_PATTERN, SALARY_RANGE_PATTERN, SALARY_TO_PATTERN,
    TITLE_SEPARATOR, TITLE_SEPARATOR_PATTERN,
)
from .text import let, strip


def _amount(digits: Column) -> Column:
    return F.replace(digits, F.lit(","), F.lit("")).try_cast("double")


def parse_salary_text(segment: Column) -> Column:
    """``struct(low, high)`` of a salary segment, NULL when it is not one.

    Shapes: range (either dash, swapped when reversed), open lower or upper bound,
    exact amount.
    """
    ranged, low_only, high_only, exact = (
        SALARY_RANGE_PATTERN, SALARY_FROM_PATTERN, SALARY_TO_PATTERN, SALARY_EXACT_PATTERN)
    first = _amount(F.regexp_extract(segment, ranged, 1))
    second = _amount(F.regexp_extract(segment, ranged, 2))
    single = _amount(F.regexp_extract(segment, exact, 1))
    none = F.lit(None).cast("double")

    def bounds(low: Column, high: Column) -> Column:
        return F.struct(low.alias("low"), high.alias("high"))

    return (
        F.when(segment.rlike(ranged), bounds(F.least(first, second), F.greatest(first, second)))
        .when(segment.rlike(low_only), bounds(_amount(F.regexp_extract(segment, low_only, 1)), none))
        .when(segment.rlike(high_only), bounds(none, _amount(F.regexp_extract(segment, high_only, 1))))
        .when(segment.rlike(exact), bounds(single, single))
    )


def parse_packed_title(raw: Column) -> Column:
    """``struct(title, company, location, remote, salary_min, salary_max, salary_currency)``.

    The last separator word divides title from tail, since a title may contain the
    word itself. Tail segments that are neither salary nor the remote word are
    kept as location.
    """
    none = F.lit(None).cast("double")

    def fields(p: Column) -> Column:
        packed = F.size(p["tail"]) > 0
        first = F.try_element_at(p["tail"], F.lit(1))
        rest = F.slice(p["tail"], F.lit(2), F.size(p["tail"]))
        marked = F.transform(rest, lambda s: F.struct(
            s.alias("text"), parse_salary_text(s).alias("salary"), (s == REMOTE_WORD).alias("remote")))
        return let(marked, lambda segments: F.struct(
            p["title"].alias("title"),
            F.when(packed, first).otherwise(F.lit("")).alias("company"),
            F.array_join(F.transform(
                F.filter(segments, lambda s: ~s["remote"] & s["salary"].isNull()),
                lambda s: s["text"]), ", ").alias("location"),
            F.exists(segments, lambda s: s["remote"]).alias("remote"),
            *_salary_fields(segments, none),
        ))

    def divide(pieces: Column) -> Column:
        head = F.array_join(
            F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(1))),
            TITLE_SEPARATOR)
        tail = F.filter(F.transform(F.split(F.element_at(pieces, -1), ","), strip), lambda s: s != "")
        return F.struct(
            strip(head).alias("title"),
            F.when(F.size(pieces) >= 2, tail).otherwise(F.array().cast("array<string>")).alias("tail"))

    pieces = F.split(raw, TITLE_SEPARATOR_PATTERN)
    return let(let(pieces, divide), fields)


def _salary_fields(segments: Column, none: Column) -> list[Column]:
    """The last salary segment decides."""
    paid = F.filter(segments, lambda s: s["salary"].isNotNull())
    salary = F.try_element_at(paid, F.lit(-1))["salary"]
    return [
        F.coalesce(salary["low"], none).alias("salary_min"),
        F.coalesce(salary["high"], none).alias("salary_max"),
        F.when(salary.isNotNull(), F.lit("USD")).otherwise(F.lit("")).alias("salary_currency"),
    ]
