"""Stored tables: plain, append-only and bucketed snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import POSTING, ddl


def scan_table(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """A stored table, only the named columns when given."""
    rows = spark.read.parquet(path)
    return rows.select(*columns) if columns else rows


def scan_posting(spark: SparkSession, path: str) -> DataFrame:
    """Stored postings; columns added later get their default for old files."""
    rows = spark.read.schema(ddl(POSTING)).parquet(path)
    return rows.withColumn("status", F.coalesce("status", F.lit("active"))).withColumn(
        "missed_run_count", F.coalesce("missed_run_count", F.lit(0)))


def write_bucketed(df: DataFrame, table: str, keys: list[str], buckets: int) -> None:
    """Store a snapshot bucketed and sorted by its key, so joins on it need no shuffle."""
    df.write.mode("errorifexists").bucketBy(buckets, *keys).sortBy(*keys).format(
        "parquet").saveAsTable(table)


def write_by_source(df: DataFrame, path: str) -> None:
    """Store rows in one folder per source, so a source filter reads only its folders.

    Rows stay in the tasks they are in: a source holding a third of them is written
    by all of those, not by one.
    """
    df.write.mode("errorifexists").partitionBy("source").parquet(path)


#: Parquet settings of a table that is looked up by id.
ROW_GROUP_BYTES = 16 << 20
#: Values of an IN filter that Spark hands to Parquet one by one unless configured otherwise.
PUSHED_VALUES = 10


def id_options(key: str) -> dict[str, str]:
    """A Bloom filter on ``key`` in every row group: ids that lie between others are told apart."""
    return {f"parquet.bloom.filter.enabled#{key}": "true", "parquet.block.size": str(ROW_GROUP_BYTES)}


def one_of(column: str, values: Sequence) -> Column:
    """``column`` is one of ``values``, in runs of ``PUSHED_VALUES`` neighbours.

    A longer list would reach the Parquet scan as its smallest and largest value alone.
    """
    ordered = sorted(values)
    found = F.lit(False)
    for at in range(0, len(ordered), PUSHED_VALUES):
        run = F.col(column).isin(ordered[at:at + PUSHED_VALUES])
        found = run if at == 0 else found | run
    return found


def write_by_id(df: DataFrame, path: str, key: str = "id", files: int | None = None, **options: str) -> None:
    """Store rows so that a few ids read few row groups.

    Rows are clustered by ranges of ``key`` and sorted within them, so the ranges of row groups
    do not overlap and an IN filter, pushed to the scan, skips all that hold none of the ids.
    The ranges come from a sample; ``files`` says how many.
    """
    ranged = df.repartitionByRange(files, key) if files else df.repartitionByRange(key)
    ranged.sortWithinPartitions(key).write.mode("errorifexists").options(
        **{**id_options(key), **options}).parquet(path)


def append(df: DataFrame, path: str) -> None:
    """Append rows to a log table."""
    df.write.mode("append").parquet(path)


def backfill(posting: DataFrame, as_of) -> DataFrame:
    """Change rows that queue every stored posting again."""
    return posting.select(F.col("id").alias("vacancy_id"), as_of.alias("published_at"))
