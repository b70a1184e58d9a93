"""Dates, money, scores, maps and tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (
    COUNTRY_CURRENCY, DAYS_PER_MONTH, HOURS_PER_DAY, SCORE_HIGH, SCORE_MID, UNIT_PERIOD,
)
from .text import let

# Zone names mail dates may carry instead of an offset.
_ZONES = {
    "UT": "+0000", "UTC": "+0000", "GMT": "+0000", "Z": "+0000",
    "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500",
    "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}


def map_lookup(table: dict[str, str], key: Column, default: str) -> Column:
    """Constant-map lookup with a default, without a join."""
    pairs = [F.lit(item) for pair in table.items() for item in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def country_currency(country: Column) -> Column:
    return map_lookup(COUNTRY_CURRENCY, country, "")


def unit_period(unit: Column) -> Column:
    return map_lookup(UNIT_PERIOD, unit, "")


# --- date / time -------------------------------------------------------------

def epoch_to_ts(seconds: Column) -> Column:
    """Seconds since the epoch; 0 and NULL mean 'not given'."""
    return F.when(seconds != 0, F.timestamp_seconds(seconds))


def rfc2822_to_epoch(text: Column) -> Column:
    """Mail-style date to epoch seconds, NULL when it cannot be read."""
    shape = (
        r"\A\s*(?:[A-Za-z]+,\s*)?(\d{1,2})\s+([A-Za-z]{3})[a-z]*\s+(\d{2,4})\s+"
        r"(\d{1,2}):(\d{2})(?::(\d{2}))?(?:\s+([+-]\d{4}|[A-Za-z]+))?.*"
    )

    def read(p: Column) -> Column:
        year = p[2].try_cast("int")
        full_year = (
            F.when(F.length(p[2]) > 2, year).when(year > 68, year + 1900).otherwise(year + 2000))
        zone = F.when(p[6].rlike(r"\A[+-]"), p[6]).otherwise(
            map_lookup(_ZONES, F.upper(p[6]), "+0000"))
        assembled = F.concat_ws(
            " ", F.lpad(p[0], 2, "0"), F.initcap(p[1]), F.lpad(full_year.cast("string"), 4, "0"),
            F.concat_ws(":", F.lpad(p[3], 2, "0"), p[4], F.when(p[5] == "", "00").otherwise(p[5])),
            zone)
        stamp = F.try_to_timestamp(assembled, F.lit("dd MMM yyyy HH:mm:ss Z"))
        return F.unix_seconds(stamp)

    # One pass of the pattern; text that does not fit stays in one piece.
    parts = F.split(F.regexp_replace(text, shape, "$1|$2|$3|$4|$5|$6|$7"), r"\|")
    return let(parts, lambda p: F.when(F.size(p) == 7, read(p)))


def iso_date(text: Column) -> Column:
    """``YYYY-MM-DD`` to date, NULL when malformed."""
    return F.when(text.rlike(r"\A\d{4}-\d{2}-\d{2}\z"), text.try_cast("date"))


def days_before(as_of: Column, days: int) -> Column:
    return as_of - F.make_dt_interval(days=F.lit(days))


def month_label(day: Column) -> Column:
    """``MM/yyyy``; no end date means the position is current."""
    return F.coalesce(F.date_format(day, "MM/yyyy"), F.lit("Present"))


# --- money and scores --------------------------------------------------------

def monthly_salary(low: Column, high: Column, period: Column) -> Column:
    """``struct(low, high)`` per month; NULL unless both bounds are known."""
    hourly = HOURS_PER_DAY * DAYS_PER_MONTH

    def monthly(amount: Column) -> Column:
        return (
            F.when(period == "year", amount / 12)
            .when(period == "hour", amount * F.lit(hourly))
            .otherwise(amount)
        )

    return F.when(
        low.isNotNull() & high.isNotNull(),
        F.struct(monthly(low).alias("low"), monthly(high).alias("high")),
    )


def _money(amount: Column) -> Column:
    """Thousands separators, no decimals, halves to even."""
    return F.format_number(F.rint(amount), 0)


def salary_label(
    low: Column, high: Column, currency: Column, period: Column, predicted: Column
) -> Column:
    """Text on a result card; zero counts as 'not given'. NULL when neither bound is."""
    has_low = F.coalesce(low != 0, F.lit(False))
    has_high = F.coalesce(high != 0, F.lit(False))
    amount = (
        F.when(has_low & has_high, F.concat(_money(low), F.lit("–"), _money(high)))
        .when(has_low, F.concat(F.lit("from "), _money(low)))
        .when(has_high, F.concat(F.lit("up to "), _money(high)))
    )
    unit = F.concat(
        F.coalesce(currency, F.lit("")),
        F.when(F.coalesce(period, F.lit("")) != "", F.concat(F.lit("/"), period)).otherwise(F.lit("")),
    )
    note = F.when(predicted, F.lit("(estimated)")).otherwise(F.lit(""))
    return F.when(
        amount.isNotNull(),
        F.array_join(F.filter(F.array(amount, unit, note), lambda s: s != ""), " "),
    )


def display_score(raw: Column, adjustment: Column) -> Column:
    """0-100 score: half-even rounding, then the adjustment, then the clamp."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.rint(raw * 100).cast("int") + adjustment))


def score_band(score: Column) -> Column:
    return (
        F.when(score >= SCORE_HIGH, F.lit("high"))
        .when(score >= SCORE_MID, F.lit("mid"))
        .otherwise(F.lit("low"))
    )


# --- tags --------------------------------------------------------------------

def tags_join(tags: Column) -> Column:
    return F.array_join(tags, ",")


def tags_split(text: Column) -> Column:
    """Stored comma text back to a list; empty items vanish."""
    return F.filter(F.split(text, ","), lambda t: t != "")


def clean_text(value: Column) -> Column:
    """Missing and NULL alike become the empty string."""
    return F.coalesce(value, F.lit(""))


def place(*parts: Column) -> Column:
    """Join the non-blank parts by ``', '``."""
    return F.array_join(
        F.filter(F.array(*[clean_text(p) for p in parts]), lambda p: p != ""), ", ")


