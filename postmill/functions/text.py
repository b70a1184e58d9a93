"""String helpers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    FOOTER_FIXED, FOOTER_MULTI, NOT_ALNUM, REQUIREMENT_MARKERS, SENIORITY_LEVELS, WS,
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it.

    Nested string expressions would otherwise be copied into every use, and the
    copies multiply with each level.
    """
    return F.transform(F.array(value), body)[0]


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add ``value`` as a column that later filters cannot copy.

    Catalyst pushes a filter below the projection it refers to and evaluates an
    expensive expression there a second time; it does not push below a generator.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def quote(literal: str) -> str:
    """Escape ``literal`` for a regex."""
    return "".join("\\" + ch if ch.isascii() and not (ch.isalnum() or ch in " \n\t") else ch
                   for ch in literal)


def strip(text: Column) -> Column:
    """Trim Unicode white space at both ends (``trim`` only knows the blank)."""
    return F.regexp_replace(text, rf"\A{WS}+|{WS}+\z", "")


def squeeze(text: Column) -> Column:
    """Collapse every run of white space to one blank and trim."""
    return F.trim(F.regexp_replace(text, rf"{WS}+", " "))


def norm_company(name: Column) -> Column:
    """Comparison key of a company: trimmed and case-folded."""
    folded = F.translate(F.lower(strip(name)), "ςſµ", "σsμ")
    return F.replace(folded, F.lit("ß"), F.lit("ss"))


def haystack(title: Column, description: Column, tags: Column, tag_separator: str = " ") -> Column:
    """Lower-cased search text. Training joins tags by ``,``, scoring by a blank."""
    return F.lower(F.concat_ws(
        " ", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit("")),
        F.array_join(F.coalesce(tags, F.array().cast("array<string>")), tag_separator),
    ))


def word_pattern(word: str) -> str:
    """``word`` whose neighbours are not letters or digits (so ``c++`` works)."""
    return rf"(?:\A|{NOT_ALNUM}){quote(word)}(?:\z|{NOT_ALNUM})"


#: The same test for a ``word`` column, taken literally, in a ``hay`` column.
WHOLE_WORD_SQL = (
    r"rlike(hay, concat(r'(?:\A|[^\p{L}\p{N}])', regexp_replace(word, r'([^\p{L}\p{N}\s])', r'\\$1'), "
    r"r'(?:\z|[^\p{L}\p{N}])'))")


def word_mentioned(text: Column, word: str) -> Column:
    """Whole-word test on lower-cased text; the cheap byte search runs first."""
    return F.contains(text, F.lit(word)) & text.rlike(word_pattern(word))


def word_marks(
    text: Column, words: Sequence[str], mark: Callable[[str], Column] = F.lit,
) -> Column:
    """``mark(word)`` for every entry of ``words`` found in ``text``, NULL for the others.

    Dropping the NULLs here would take a higher-order function and with it the
    projection out of whole-stage code generation; explode and filter instead.
    """
    return F.array(*[F.when(word_mentioned(text, w), mark(w)) for w in words])


def clean_words(words: Sequence[str]) -> list[str]:
    """Trimmed, lower-cased, non-blank words in the given order, repeats kept."""
    return [w.strip().lower() for w in words if w.strip()]


def any_keyword(text: Column, keywords: Sequence[str], when_empty: bool) -> Column:
    """Case-insensitive substring any-of over already lower-cased ``text``."""
    found = F.lit(False) if keywords else F.lit(when_empty)
    for keyword in keywords:
        found = found | F.contains(text, F.lit(keyword.lower()))
    return found


def primary_seniority(lowered: Column, levels: Sequence[str] = SENIORITY_LEVELS) -> Column:
    """The level whose first plain occurrence comes earliest, among whole-word matches.

    ``lowered`` is the lower-cased title.
    """
    found = word_marks(lowered, levels, lambda level: F.struct(
        F.locate(level, lowered).alias("pos"), F.lit(level).alias("level")))
    return F.array_min(found)["level"]  # skips NULL entries


def marker_pattern(markers: Sequence[str] = REQUIREMENT_MARKERS) -> str:
    """Group 1 is everything before the earliest heading.

    A heading follows the start of the text or a character that is no letter or
    digit, and is not followed by a full stop. The lazy group makes the engine try
    positions left to right, so one pass covers all headings.
    """
    names = "|".join(quote(m) for m in markers)
    return rf"(?s)\A(|.*?{NOT_ALNUM})(?:{names})(?:[^.]|\z)"


def marker_prefix_length(description: Column, markers: Sequence[str] = REQUIREMENT_MARKERS) -> Column:
    """Code points before the earliest heading; 0 when there is none or it comes first."""
    lowered = F.lower(description)
    some = F.lit(False)
    for marker in markers:
        some = some | F.contains(lowered, F.lit(marker))
    return F.when(
        some, F.length(F.regexp_extract(lowered, marker_pattern(markers), 1))
    ).otherwise(F.lit(0))


def reorder_description(description: Column, prefix_length: Column | None = None) -> Column:
    """Move the text from the earliest heading to the front; nothing is lost."""
    def move(cut: Column) -> Column:
        moved = F.concat(
            F.substr(description, cut + 1), F.lit(" "), F.substr(description, F.lit(1), cut))
        return F.when(cut > 0, moved).otherwise(description)

    return let(marker_prefix_length(description), move) if prefix_length is None else move(prefix_length)


def embedding_text(title: Column, description: Column, prefix_length: Column | None = None) -> Column:
    return F.concat(
        F.lit("passage: "), title, F.lit("\n\n"), reorder_description(description, prefix_length)
    )


def strip_footer_multi(text: Column) -> Column:
    """Cut the trailing platform footer that names a country."""
    return strip(F.regexp_replace(text, rf"{WS}*{FOOTER_MULTI}{WS}*\z", ""))


def strip_footer_fixed(text: Column) -> Column:
    """Cut the fixed trailing 'apply' phrase."""
    return strip(F.regexp_replace(text, rf"{WS}*{FOOTER_FIXED}{WS}*\z", ""))


def truncate(text: Column, limit: int) -> Column:
    return F.substring(text, 1, limit)


def highlight_lines(text: Column) -> Column:
    """The non-blank lines of ``text`` as an array."""
    return F.filter(F.split(text, "\n"), lambda line: strip(line) != "")
