"""Exact duplicates by 128-bit content hash, with the bytes compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower

#: Texts that differ only in the case of A-Z are one; null counts as empty.
def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def exact_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "min",
) -> DataFrame:
    """Each row's group of equal texts: ``key, text_sha256, keep_id, group_size, kept``.

    ``keep`` says whether the smallest or the largest key of a group stays. Rows are grouped
    by hash and text together, so the grouping itself compares bytes and a collision of
    hashes makes two groups; copies collapse before the shuffle, whatever a group's size.
    Rows then find their group by the hash alone, without their text. Only where one hash has
    several texts (in practice never) the text takes part in that second join as well.
    ``text_sha256`` is the digest of the normalised text.

    Null and empty texts are equal. A null key never stays ahead of another key; a group of
    null keys has a null ``keep_id`` and keeps those rows. Rows that repeat a key with the
    same text are all marked like that key. An empty table gives an empty one.
    """
    best = {"min": F.min, "max": F.max}[keep]
    size = F.count(F.lit(1)).alias("group_size")
    rows = docs.select(F.col(key), normalised(F.col(text)).alias("normal")).withColumn(
        "hash", F.unhex(F.md5("normal")))
    short = rows.select(key, "hash", F.sha2("normal", 256).alias("text_sha256"))
    scratch = Scratch(docs.sparkSession, "exact")
    by_hash, _ = scratch.cut(
        rows.groupBy("hash", "normal").agg(best(key).alias("keep_id"), size)
        .groupBy("hash").agg(
            F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"),
            F.max("group_size").alias("group_size")))
    clashing = by_hash.filter(F.col("texts") > 1).select("hash")
    if clashing.isEmpty():
        out = short.join(by_hash.drop("texts"), "hash")
    else:
        alone = short.join(by_hash.filter(F.col("texts") == 1).drop("texts"), "hash")
        mixed = rows.join(clashing, "hash", "left_semi")
        apart = mixed.groupBy("hash", "normal").agg(best(key).alias("keep_id"), size)
        out = alone.unionByName(
            mixed.join(apart, ["hash", "normal"])
            .withColumn("text_sha256", F.sha2("normal", 256)).drop("normal"))
    return out.select(
        key, "text_sha256", "keep_id", "group_size",
        F.col(key).eqNullSafe(F.col("keep_id")).alias("kept"))
