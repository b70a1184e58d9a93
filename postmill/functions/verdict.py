"""Scoring responses and the texts sent to a scorer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (
    FENCE_PATTERN, PROMPT_DESCRIPTION_LIMIT, SCORING_PROMPT, WRITING_CONTEXT,
)
from .text import let, truncate


def parse_verdict(returncode: Column, timed_out: Column, stdout: Column) -> Column:
    """``struct(outcome, score, reasoning, concerns)`` of one response row.

    Outcome is the first that applies of timeout, nonzero_exit, bad_stdout,
    api_error, parse_error, success. A score that is not an integer is a
    parse_error; a missing one is 0.
    """
    def from_envelope(envelope: Column) -> Column:
        answer = F.try_variant_get(envelope, "$.result", "string")
        body = let(answer, lambda a: F.when(
            a.rlike(FENCE_PATTERN), F.regexp_extract(a, FENCE_PATTERN, 1)).otherwise(a))
        failed = F.coalesce(F.try_variant_get(envelope, "$.is_error", "boolean"), F.lit(False))
        early = (
            F.when(timed_out, F.lit("timeout"))
            .when(returncode != 0, F.lit("nonzero_exit"))
            .when(envelope.isNull(), F.lit("bad_stdout"))
            .when(failed, F.lit("api_error"))
        )
        return let(F.try_parse_json(body), lambda verdict: let(
            _score(verdict), lambda score: let(
                F.coalesce(early, F.when(score.isNull(), F.lit("parse_error")), F.lit("success")),
                lambda outcome: _fields(outcome, score, verdict))))

    return let(F.try_parse_json(stdout), from_envelope)


def _score(verdict: Column) -> Column:
    """Whole-number score, 0 when absent, NULL when unusable."""
    def read(given: Column) -> Column:
        digits = F.regexp_extract(given, r'\A"?\s*([+-]?\d+)\s*"?\z', 1)
        number = F.when(
            given.rlike(r"\A-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?\z"), given.try_cast("double"))
        return (
            F.when(given.isNull(), F.lit(0))
            .when(digits != "", digits.try_cast("int"))
            .when(given.isin("true", "false"), (given == "true").cast("int"))
            .otherwise(F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)).try_cast("int"))
        )

    fields = F.try_variant_get(verdict, "$", "map<string,variant>")
    return let(fields, lambda f: F.when(
        f.isNotNull(), read(F.to_json(F.try_element_at(f, F.lit("score"))))))


def _fields(outcome: Column, score: Column, verdict: Column) -> Column:
    good = outcome == "success"
    no_concerns = F.array().cast("array<string>")
    return F.struct(
        outcome.alias("outcome"),
        F.when(good, score).alias("score"),
        F.when(good, F.coalesce(F.try_variant_get(verdict, "$.reasoning", "string"), F.lit("")))
        .alias("reasoning"),
        F.when(good, F.coalesce(
            F.try_variant_get(verdict, "$.concerns", "array<string>"), no_concerns)).alias("concerns"),
    )


def _skill_names(skills: Column) -> Column:
    return F.array_join(F.transform(skills, lambda s: s["name"]), ", ")


def profile_query_text(profile: Column) -> Column:
    """Text whose vector is searched for."""
    jobs = F.array_join(F.transform(
        profile["experiences"],
        lambda e: F.concat(e["title"], F.lit(" at "), e["company"], F.lit(": "), e["highlights"]),
    ), "\n")
    return F.concat(
        F.lit("query: "), profile["summary"], F.lit("\nSkills: "),
        _skill_names(profile["skills"]), F.lit("\n"), jobs)


def _experience_lines(profile: Column) -> Column:
    return F.array_join(F.transform(
        profile["experiences"],
        lambda e: F.concat(
            F.lit("- "), e["title"], F.lit(" at "), e["company"], F.lit(" ("),
            F.coalesce(e["start_date"].cast("string"), F.lit("None")), F.lit("–"),
            F.coalesce(e["end_date"].cast("string"), F.lit("present")),
            F.lit("): "), e["highlights"]),
    ), "\n")


def scoring_prompt(posting: Column, profile: Column) -> Column:
    """Prompt column for scoring one posting against one profile."""
    return F.format_string(
        SCORING_PROMPT,
        profile["summary"], _skill_names(profile["skills"]), _experience_lines(profile),
        posting["title"], posting["company"], posting["location"],
        F.initcap(posting["remote"].cast("string")),
        truncate(posting["description"], PROMPT_DESCRIPTION_LIMIT),
    )


def writing_context(posting: Column, profile: Column) -> Column:
    """Context column for writing a letter or tailoring a resume."""
    return F.format_string(
        WRITING_CONTEXT,
        profile["full_name"], profile["email"], profile["phone"], profile["summary"],
        _skill_names(profile["skills"]), _experience_lines(profile),
        posting["title"], posting["company"],
        truncate(posting["description"], PROMPT_DESCRIPTION_LIMIT),
    )
