"""Counters, rates and latency quantiles over event tables and streams.

Every aggregate here also runs on a stream: only one grouped aggregation deep.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DURATION_BOUNDS, QUANTILE


def outcome_counts(df: DataFrame, *labels: str) -> DataFrame:
    return df.groupBy(*labels).agg(F.count(F.lit(1)).alias("n"))


def rate(df: DataFrame, ts: str, labels: Sequence[str], width: str = "1 minute", seconds: int = 60) -> DataFrame:
    """Events per second in tumbling windows."""
    return (
        df.groupBy(F.window(ts, width).alias("w"), *labels)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), *labels, "n",
                (F.col("n") / F.lit(float(seconds))).alias("per_second"))
    )


def bucket_counts(value: Column, bounds: Sequence[float] = DURATION_BOUNDS) -> Column:
    """Cumulative bucket counts as one array aggregate; the last entry counts every row."""
    return F.array(*[F.count_if(value <= F.lit(b)) for b in bounds], F.count(value))


def duration_histogram(
    df: DataFrame, value: str, labels: Sequence[str], bounds: Sequence[float] = DURATION_BOUNDS,
) -> DataFrame:
    """``(labels, le, cumulative)`` with one row per bound and one for infinity.

    The counts are cumulative inside the aggregate, so no window is needed.
    """
    names = [str(b) for b in bounds] + ["+Inf"]
    return (
        df.groupBy(*labels).agg(bucket_counts(F.col(value), bounds).alias("c"))
        .select(*labels, F.explode(F.arrays_zip(
            F.array(*[F.lit(n) for n in names]).alias("le"), F.col("c").alias("cumulative"))).alias("b"))
        .select(*labels, F.col("b.le").alias("le"), F.col("b.cumulative").alias("cumulative"))
    )


def histogram_quantile(
    counts: Column, q: float = QUANTILE, bounds: Sequence[float] = DURATION_BOUNDS,
) -> Column:
    """Quantile from cumulative bucket counts by linear interpolation inside a bucket.

    A quantile in the open last bucket is the highest finite bound.
    """
    total = F.element_at(counts, -1)
    target = F.lit(q) * total
    out = F.lit(float(bounds[-1]))
    for i in reversed(range(len(bounds))):
        below = counts[i - 1] if i else F.lit(0)
        low = F.lit(float(bounds[i - 1])) if i else F.lit(0.0)
        inside = low + (F.lit(float(bounds[i])) - low) * (target - below) / (counts[i] - below)
        out = F.when(counts[i] >= target, inside).otherwise(out)
    return F.when(total > 0, out)


def quantile_p95(df: DataFrame, value: str, labels: Sequence[str], q: float = QUANTILE) -> DataFrame:
    return (
        df.groupBy(*labels).agg(bucket_counts(F.col(value)).alias("_c"))
        .select(*labels, histogram_quantile(F.col("_c"), q).alias("quantile"))
    )


def latency_quantile(
    df: DataFrame, ts: str, value: str, labels: Sequence[str],
    width: str = "5 minutes", slide: str = "1 minute", q: float = QUANTILE,
) -> DataFrame:
    """Quantile per sliding window; runs on a stream too."""
    return (
        df.groupBy(F.window(ts, width, slide).alias("w"), *labels)
        .agg(bucket_counts(F.col(value)).alias("_c"))
        .select(F.col("w.start").alias("window_start"), *labels,
                F.element_at("_c", -1).alias("n"), histogram_quantile(F.col("_c"), q).alias("quantile"))
    )


def latency_quantile_paned(
    df: DataFrame, ts: str, value: str, labels: Sequence[str],
    panes: int = 5, q: float = QUANTILE,
) -> DataFrame:
    """The batch form of ``latency_quantile`` for one-minute slides.

    Rows are reduced to one-minute panes first and only the panes are copied into
    the windows covering them, so the fan-out no longer multiplies the input.
    """
    bounds = range(len(DURATION_BOUNDS) + 1)
    counted = df.groupBy(F.date_trunc("minute", ts).alias("pane"), *labels).agg(
        *[(F.count_if(F.col(value) <= F.lit(DURATION_BOUNDS[i])) if i < len(DURATION_BOUNDS)
           else F.count(value)).alias(f"c{i}") for i in bounds])
    starts = F.array(*[F.col("pane") - F.make_dt_interval(mins=F.lit(i)) for i in range(panes)])
    return (
        counted.withColumn("window_start", F.explode(starts))
        .groupBy("window_start", *labels)
        .agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in bounds])
        .withColumn("_c", F.array(*[F.col(f"c{i}") for i in bounds]))
        .select("window_start", *labels, F.element_at("_c", -1).alias("n"),
                histogram_quantile(F.col("_c"), q).alias("quantile"))
    )


def queue_depth(changes: DataFrame, processed: DataFrame, ts: str, unit: str = "minute") -> DataFrame:
    """Published rows by state and time bucket: ready (untouched), unacked (started), done.

    ``processed(vacancy_id, finished)`` holds one or more rows per picked-up change.
    """
    picked = processed.groupBy("vacancy_id").agg(F.bool_and("finished").alias("finished"))
    state = (
        F.when(F.col("finished").isNull(), F.lit("ready"))
        .when(~F.col("finished"), F.lit("unacked"))
        .otherwise(F.lit("done"))
    )
    return (
        changes.join(picked, "vacancy_id", "left")
        .groupBy(F.date_trunc(unit, ts).alias("bucket"), state.alias("state"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
