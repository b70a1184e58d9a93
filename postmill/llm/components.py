"""Connected components over links that never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _mark(links: DataFrame) -> tuple:
    row = links.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def connected(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, root`` of every node that has a link; ``root`` is the component's smallest node.

    Star contraction: in turns, every node hands its larger neighbours, then its smaller
    ones, over to the smallest node it knows, until the links are stars. A node's minimum is
    an aggregate with a map-side half, and the links then join that one row per node, so a
    node with very many links is no single task's work. Each round is written to the shared
    folder; the number of rounds grows with the logarithm of the component size.
    """
    now, path = scratch.cut(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .filter("u <> v").distinct())
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
        large = (
            now.select(F.col("v").alias("u"), F.col("u").alias("far")).join(lowest, "u")
            .select(F.col("far").alias("u"), F.col("low").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(least, "u").select(
            F.when(F.col("v") == F.col("low"), F.col("u")).otherwise(F.col("v")).alias("u"),
            F.col("low").alias("v")).distinct()
        after, after_path = scratch.cut(small)
        after_mark = _mark(after)
        scratch.drop(path)
        now, path = after, after_path
        if after_mark == mark:
            break
        mark = after_mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
