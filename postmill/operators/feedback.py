"""What past decisions say about categories of postings.

A category (skill, remote flag, seniority level) counts once it has enough decided
rows and its negative share differs from the overall share by a margin.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    FEEDBACK_DELTA, FEEDBACK_MARGIN, FEEDBACK_MIN_SAMPLES, FEEDBACK_TOTAL_LIMIT, NEGATIVE_STATUSES,
    SENIORITY_LEVELS,
)
from ..functions.text import (
    WHOLE_WORD_SQL, clean_words, haystack, norm_company, primary_seniority, strip, word_marks,
    word_mentioned,
)
from ..session import cut
from .filters import SALTS

#: Categories that become a constant instead of a join.
MOST_CONSTANTS = 1000
#: Texts that tell which tokens are rare, and words of a vocabulary that is broadcast.
SAMPLE_TEXTS = 200
FEW_WORDS = 50_000
#: Longs of a Bloom filter of anchors: two million bits, whatever the vocabulary.
BLOOM_SLOTS = 1 << 15


def is_negative(status: Column) -> Column:
    return F.coalesce(status.isin(*NEGATIVE_STATUSES), F.lit(False))


def tracked_rows(posting: DataFrame, application: DataFrame, **columns: Column) -> DataFrame:
    """``posting`` ⨝ ``application`` reduced to ``negative`` and the given columns.

    Postings without a decision go first, then the columns are computed, then the join
    brings in the decisions: no text of an undecided posting is searched, and none moves
    for the sake of the decision.
    """
    decided = application.select("vacancy_id", is_negative(F.col("status")).alias("negative"))
    picked = [c.alias(n) for n, c in columns.items()]
    return (
        posting.join(decided.select(F.col("vacancy_id").alias("id")), "id", "left_semi")
        .select("id", *picked)
        .join(decided, F.col("vacancy_id") == F.col("id"))
        .select("negative", *columns)
    )


def baseline_ratio(posting: DataFrame, application: DataFrame) -> DataFrame:
    """Share of negative decisions among all tracked postings."""
    return tracked_rows(posting, application).agg(
        F.avg(F.col("negative").cast("double")).alias("baseline"))


def _signal(total: Column, negatives: Column, baseline: Column) -> Column:
    ratio = negatives / total
    return (
        F.when(total < FEEDBACK_MIN_SAMPLES, F.lit(None).cast("int"))
        .when(ratio - baseline >= FEEDBACK_MARGIN, F.lit(-FEEDBACK_DELTA))
        .when(baseline - ratio >= FEEDBACK_MARGIN, F.lit(FEEDBACK_DELTA))
    )


def category_feedback(tracked: DataFrame, categories: Column, keep_silent: bool = False) -> DataFrame:
    """``(category, total, negatives, delta)`` for an array-valued ``categories`` column.

    A row may belong to several categories, and to one of them repeatedly.
    ``tracked`` needs a boolean ``negative``. The counts combine map-side, so a
    category holding most rows costs no more than any other.
    """
    baseline = tracked.agg(F.avg(F.col("negative").cast("double")).alias("b")).scalar()
    # explode_outer, not explode: the latter makes Spark infer a filter on the array,
    # push it below the join and search every text a second time.
    counted = (
        tracked.select("negative", F.explode_outer(categories).alias("category"))
        .filter(F.col("category").isNotNull())
        .groupBy("category")
        .agg(F.count(F.lit(1)).alias("total"), F.count_if("negative").alias("negatives"))
        .withColumn("_baseline", baseline)
        .withColumn("delta", _signal(F.col("total"), F.col("negatives"), F.col("_baseline")))
        .drop("_baseline")
    )
    return counted if keep_silent else counted.filter(F.col("delta").isNotNull())


def searchable(posting: DataFrame, separator: str = ",") -> DataFrame:
    """Add the lower-cased search text ``hay`` and ``lower_title``, each computed once."""
    return posting.withColumn(
        "hay", haystack(F.col("title"), F.col("description"), F.col("tags"), separator)
    ).withColumn("lower_title", F.lower("title"))


def skill_categories(skills: Sequence[str]) -> Column:
    """Skills found in ``hay``; NULL entries stand for the others and never count."""
    words = clean_words(skills)
    return word_marks(F.col("hay"), words) if words else F.array().cast("array<string>")


def remote_categories() -> Column:
    """Only ``remote``: an unset flag does not mean on site."""
    return F.array(F.when(F.col("remote"), F.lit("remote")))


def seniority_categories(levels: Sequence[str] = SENIORITY_LEVELS) -> Column:
    return F.array(primary_seniority(F.col("lower_title"), levels))


def skill_feedback(posting: DataFrame, application: DataFrame, skills: Sequence[str]) -> DataFrame:
    tracked = tracked_rows(
        searchable(posting), application, categories=skill_categories(skills))
    return category_feedback(tracked, F.col("categories"))


def remote_feedback(posting: DataFrame, application: DataFrame) -> DataFrame:
    tracked = tracked_rows(posting, application, categories=remote_categories())
    return category_feedback(tracked, F.col("categories"))


def seniority_feedback(posting: DataFrame, application: DataFrame) -> DataFrame:
    tracked = tracked_rows(searchable(posting), application, categories=seniority_categories())
    return category_feedback(tracked, F.col("categories"))


def _tag(dimension: str, category: Column) -> Column:
    return F.when(category.isNotNull(), F.struct(
        F.lit(dimension).alias("dimension"), category.alias("category")))


def _signal_tags(skills: Sequence[str], levels: Sequence[str]) -> list[Column]:
    hay = F.col("hay")
    return [
        *[_tag("skill", F.when(word_mentioned(hay, w), F.lit(w))) for w in clean_words(skills)],
        _tag("remote", F.when(F.col("remote"), F.lit("remote"))),
        _tag("seniority", primary_seniority(F.col("lower_title"), levels)),
    ]


def all_feedback(
    posting: DataFrame, application: DataFrame, skills: Sequence[str],
    levels: Sequence[str] = SENIORITY_LEVELS,
) -> DataFrame:
    """The three signals from one pass: ``(dimension, category, total, negatives, delta)``."""
    tracked = tracked_rows(
        searchable(posting), application, categories=F.array(*_signal_tags(skills, levels)))
    return category_feedback(tracked, F.col("categories")).select(
        "category.*", "total", "negatives", "delta")


def decision_summary(
    posting: DataFrame, application: DataFrame, skills: Sequence[str], companies: Sequence[str],
    levels: Sequence[str] = SENIORITY_LEVELS,
) -> tuple[dict[tuple[str, str], int], list[str]]:
    """Signals by ``(dimension, category)`` and the excluded ones among ``companies``.

    One aggregate over all decided postings counts every category that is asked about,
    the named companies and the whole. At most one row per skill, level and company comes
    to the driver.
    """
    key = norm_company(F.col("company"))
    tags = [
        *_signal_tags(skills, levels), _tag("all", F.lit("")),
        _tag("company", F.when(key.isin(list(companies)) & (key != ""), key)),
    ]
    counted = {
        (row.dimension, row.category): (row.total, row.negatives)
        for row in tracked_rows(searchable(posting), application, tags=F.array(*tags))
        .select("negative", F.explode_outer("tags").alias("tag"))
        .filter(F.col("tag").isNotNull())
        .groupBy("tag")
        .agg(F.count(F.lit(1)).alias("total"), F.count_if("negative").alias("negatives"))
        .select("tag.*", "total", "negatives").collect()
    }
    total, negatives = counted.pop(("all", ""), (0, 0))
    signals, excluded = {}, []
    for (dimension, category), (n, bad) in counted.items():
        if dimension == "company":
            if n == bad:
                excluded.append(category)
        elif n >= FEEDBACK_MIN_SAMPLES:
            ahead = bad / n - negatives / total
            if abs(ahead) >= FEEDBACK_MARGIN:
                signals[dimension, category] = -FEEDBACK_DELTA if ahead > 0 else FEEDBACK_DELTA
    return signals, excluded


def excluded_companies(
    posting: DataFrame, application: DataFrame, only: DataFrame | None = None,
) -> DataFrame:
    """Companies whose every tracked application is negative: ``(company_key, n)``.

    A blank name is no company. ``only(company_key)`` restricts the answer to the
    companies a caller asks about, before anything is shuffled by company.
    """
    tracked = tracked_rows(posting, application, company_key=norm_company(F.col("company"))).filter(
        F.col("company_key") != "")
    if only is not None:
        tracked = tracked.join(only.select("company_key").distinct(), "company_key", "left_semi")
    return (
        tracked.groupBy("company_key")
        .agg(F.bool_and("negative").alias("all_negative"), F.count(F.lit(1)).alias("n"))
        .filter("all_negative")
        .select("company_key", "n")
    )


def score_adjustment(parts: Column) -> Column:
    """Clamp the summed deltas."""
    return F.greatest(
        F.lit(-FEEDBACK_TOTAL_LIMIT), F.least(F.lit(FEEDBACK_TOTAL_LIMIT), parts)).cast("int")


def collect_signals(feedback: DataFrame) -> dict[tuple[str, str], int]:
    """``(dimension, category) -> delta``; at most one row per asked skill and level, plus remote."""
    rows = feedback.select("dimension", "category", "delta").collect()
    return {(row.dimension, row.category): row.delta for row in rows}


def with_adjustment(
    df: DataFrame, signals: dict[tuple[str, str], int], skills: Sequence[str],
    levels: Sequence[str] = SENIORITY_LEVELS,
) -> DataFrame:
    """Add ``adjustment`` per row from the few signals that hold, as constants.

    Only skills that carry a signal are searched for; each counts once.
    """
    total = F.lit(0)
    for skill in dict.fromkeys(clean_words(skills)):
        delta = signals.get(("skill", skill))
        if delta:
            total = total + F.when(word_mentioned(F.col("hay"), skill), delta).otherwise(0)
    if ("remote", "remote") in signals:
        total = total + F.when(F.col("remote"), signals["remote", "remote"]).otherwise(0)
    ranked = {name: delta for (kind, name), delta in signals.items() if kind == "seniority"}
    if ranked:
        level = primary_seniority(F.col("lower_title"), levels)
        pairs = [F.lit(item) for pair in ranked.items() for item in pair]
        total = total + F.coalesce(F.try_element_at(F.create_map(*pairs), level), F.lit(0))
    return searchable(df, " ").withColumn("adjustment", score_adjustment(total)).drop(
        "hay", "lower_title")


def join_feedback_delta(categories: DataFrame, feedback: DataFrame, key: str = "id") -> DataFrame:
    """Sum of deltas per posting from exploded ``(key, category)`` rows; no match adds 0.

    ``feedback`` has at most one row per category. Up to ``MOST_CONSTANTS`` of them become a
    constant, so the exploded rows are not shuffled by their few categories. More are joined,
    each in ``SALTS`` copies, so a frequent category is not one task's work.
    """
    few = feedback.select("category", "delta").limit(MOST_CONSTANTS + 1).collect()
    if len(few) <= MOST_CONSTANTS:
        pairs = [F.lit(item) for row in few for item in row]
        delta = F.try_element_at(F.create_map(*pairs), F.col("category")) if pairs else F.lit(0)
        found = categories.select(key, delta.alias("delta"))
    else:
        copies = feedback.select(
            "category", "delta", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
        found = categories.select(
            key, "category", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int").alias("_salt")
        ).join(copies, ["category", "_salt"], "left")
    return found.groupBy(key).agg(F.sum(F.coalesce("delta", F.lit(0))).cast("int").alias("delta"))


def theta_join_words(posting: DataFrame, words: Sequence[str], separator: str = ",") -> DataFrame:
    """``(id, word)`` for every word of a short list found in a posting; no join at all."""
    return searchable(posting, separator).select(
        "id", F.explode_outer(skill_categories(words)).alias("word")
    ).filter(F.col("word").isNotNull())


def anchor_bits(anchors: DataFrame) -> Column:
    """A Bloom filter of ``BLOOM_SLOTS`` longs over the column ``anchor``, as one constant array."""
    slot, bit = _place(F.col("anchor"))
    set_bits = anchors.groupBy(slot.alias("slot")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    slots = anchors.sparkSession.range(BLOOM_SLOTS).select(F.col("id").cast("int").alias("slot"))
    listed = slots.join(set_bits, "slot", "left").select(
        F.struct("slot", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("s"))
    return listed.agg(F.transform(
        F.array_sort(F.collect_list("s")), lambda s: s["bits"]).alias("bits")).scalar()


def _place(anchor: Column) -> tuple[Column, Column]:
    code = F.xxhash64(anchor)
    return F.pmod(code, F.lit(BLOOM_SLOTS)).cast("int"), F.pmod(
        F.shiftright(code, 32), F.lit(64)).cast("int")


def _may_hold(bits: Column, anchor: Column) -> Column:
    slot, bit = _place(anchor)
    return F.getbit(F.get(bits, slot), bit) == 1


def theta_join_single_words(posting: DataFrame, words: DataFrame, separator: str = ",") -> DataFrame:
    """``(id, word)`` for a *table* of words of any size and any characters.

    A text can only hold a word if it holds each run of letters and digits of the word and each
    of its other characters. The rarest of these is the word's anchor: by their frequency in
    ``SAMPLE_TEXTS`` of the texts, then the longest. So the theta join is an equi-join of anchors
    with the distinct runs and other characters of each text. A word that is one run is found
    by that alone; the others are then tested as whole words in the text, which goes along with
    their anchors only.

    A vocabulary of up to ``FEW_WORDS`` is broadcast, and nothing moves. For a larger one two
    Bloom filters of the anchors, of fixed size, let only anchors through to the join, which
    takes a text along for the anchors of longer words alone; AQE splits an anchor that holds
    many postings. What the sample says changes the work only, never the result.
    """
    run = r"[\p{L}\p{N}]+"
    token = F.lit(rf"{run}|[^\p{{L}}\p{{N}}\s]")

    def tokens(text: Column) -> Column:
        return F.array_distinct(F.regexp_extract_all(text, token, F.lit(0)))

    hay = searchable(posting, separator).select("id", "hay")
    lowered = words.select(F.lower(strip(F.col("word"))).alias("word")).filter("word <> ''").distinct()
    seen = hay.limit(SAMPLE_TEXTS).select(F.explode(tokens(F.col("hay"))).alias("anchor")).groupBy(
        "anchor").agg(F.count(F.lit(1)).alias("n"))
    parts = lowered.select("word", F.explode(tokens(F.col("word"))).alias("anchor"))
    vocabulary = (
        parts.join(seen, "anchor", "left").groupBy("word").agg(F.min(F.struct(
            F.coalesce("n", F.lit(0)).alias("n"), (-F.length("anchor")).alias("size"), "anchor",
        )).alias("best"))
        .select("word", "best.anchor", (F.col("best.anchor") == F.col("word")).alias("single")))
    # One generated loop from here: a text is not copied for a token that leads nowhere.
    found = hay.select("id", "hay", F.explode_outer(tokens(F.col("hay"))).alias("anchor"))
    few = vocabulary.limit(FEW_WORDS + 1).collect()
    if len(few) <= FEW_WORDS:
        vocabulary = F.broadcast(posting.sparkSession.createDataFrame(few, vocabulary.schema))
    else:
        vocabulary = cut(vocabulary, "vocabulary")
        single, several = (anchor_bits(vocabulary.filter(c)) for c in ("single", "NOT single"))
        in_several = _may_hold(several, F.col("anchor"))
        found = found.filter(_may_hold(single, F.col("anchor")) | in_several).select(
            "id", "anchor", F.when(in_several, F.col("hay")).alias("hay"))
    # The common case, a word between blanks, needs no pattern.
    whole = F.contains("hay", F.col("word")) & (
        F.contains("hay", F.concat(F.lit(" "), "word", F.lit(" "))) | F.expr(WHOLE_WORD_SQL))
    return found.join(vocabulary, "anchor").filter(F.col("single") | whole).select("id", "word")
