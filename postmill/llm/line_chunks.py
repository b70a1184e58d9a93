"""Repeated runs of lines, cut at boundaries that the lines themselves choose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .common import Scratch

#: Lines of a chunk, on average.
MEAN_LINES = 3


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def chunk_ends(lines: Column, mean_lines: int) -> Column:
    """Number of lines up to the end of every chunk.

    A line ends a chunk when the rolling hash over its own and the previous line's hash is
    lower than those of the ``mean_lines // 2`` lines before it and after it; so does the last
    line. Two ends are thus at least two lines apart, and the first line and the last but one
    are none, so only a text of one line has a chunk of one. Lines put in before a passage
    move its chunks but do not change them.
    """
    reach = max(1, mean_lines // 2)

    def rolling(hashes: Column) -> Column:
        return F.transform(hashes, lambda own, at: F.conv(F.substring(F.md5(F.concat(
            F.coalesce(F.get(hashes, at - 1), F.lit("")), own)), 1, 8), 16, 10).cast("long"))

    def ends(rolled: Column) -> Column:
        def stops(line: Column) -> Column:
            own = F.get(rolled, line - 1)
            lower = (line > 1) & (line < F.size(rolled) - 1)
            for away in range(1, reach + 1):
                for other in (line - 1 - away, line - 1 + away):
                    lower = lower & (own < F.coalesce(F.get(rolled, other), F.lit(1 << 32)))
            return (line == F.size(rolled)) | lower

        return F.filter(F.sequence(F.lit(1), F.size(rolled)), stops)

    return let(let(F.transform(lines, F.md5), rolling), ends)


def chunks_of(lines: Column, mean_lines: int) -> Column:
    """Multi-line chunks as ``first`` (lines before it), ``n`` (its lines) and ``chunk`` (its text)."""
    def cut(own: Column) -> Column:
        def between(ends: Column) -> Column:
            def one(end: Column, at: Column) -> Column:
                before = F.when(at == 0, 0).otherwise(F.get(ends, at - 1))
                return F.struct(
                    before.alias("first"), (end - before).alias("n"),
                    F.when(end - before > 1, F.array_join(F.slice(own, before + 1, end - before), "\n"))
                    .alias("chunk"))

            return F.filter(F.transform(ends, one), lambda c: c["n"] > 1)

        return let(chunk_ends(own, mean_lines), between)

    return let(lines, cut)


def without(lines: Column, ranges: Column) -> Column:
    """``lines`` outside the sorted ``ranges`` (``first``, ``n``), in one pass over both."""
    def kept(all_ranges: Column) -> Column:
        def gap(r: Column, at: Column) -> Column:
            before = F.get(all_ranges, at - 1)
            done = F.when(at == 0, 0).otherwise(before["first"] + before["n"])
            return F.slice(lines, done + 1, r["first"] - done)

        return F.flatten(F.transform(all_ranges, gap))

    end = F.array(F.struct(F.size(lines).alias("first"), F.lit(0).alias("n")))
    return let(F.concat(ranges, end), kept)


def remove_repeated_chunks(
    docs: DataFrame, key: str = "doc_id", text: str = "text", mean_lines: int = MEAN_LINES,
) -> DataFrame:
    """All columns of ``docs`` with ``kept_text``, ``n_lines`` and ``n_removed`` added.

    Lines end at a line feed. Of a chunk of two lines or more that occurs again anywhere, the
    occurrence with the smallest key, and the earliest in it, stays; the others go.
    ``kept_text`` is the rest, unchanged where nothing went. ``key`` is an integral column.

    Chunks are grouped by their 128-bit hash and their text together, which compares bytes;
    copies collapse before the shuffle. Occurrences then look their group up by hash alone;
    only a hash with several texts (in practice none) takes the text along. Everything is
    built of column functions.

    Null texts count as empty, one empty line, and give an empty ``kept_text``. Rows with a
    null key neither lose nor take chunks. Rows that repeat a key are told apart by their
    text; equal rows fare alike. An empty table gives an empty one. Columns of ``docs`` named
    like an added one are replaced.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    own = docs.drop("kept_text", "n_lines", "n_removed")
    column = F.col(f"`{text}`")
    marked = own.select(
        F.struct(*[F.col(f"`{c}`") for c in own.columns]).alias("row"),
        F.col(f"`{key}`").alias("doc"), F.xxhash64(F.coalesce(column, F.lit(""))).alias("own"))
    # The place of an occurrence: document, then line, as one number.
    place = F.col("doc").cast("decimal(38,0)") * F.lit(1 << 31).cast("decimal(11,0)") + F.col("c.first")
    found = (
        docs.filter(F.col(f"`{key}`").isNotNull() & F.contains(column, F.lit("\n")))
        .select(F.col(f"`{key}`").alias("doc"), F.xxhash64(column).alias("own"),
                F.explode(chunks_of(lines_of(column), mean_lines)).alias("c"))
        .select("doc", "own", "c.first", "c.n", "c.chunk", F.unhex(F.md5("c.chunk")).alias("hash"),
                place.cast("decimal(38,0)").alias("place")))
    groups = (
        found.groupBy("hash", "chunk")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("place").alias("stays"))
        .groupBy("hash").agg(
            F.count(F.lit(1)).alias("texts"), F.max("copies").alias("copies"),
            F.min("stays").alias("stays"))
        .filter("copies > 1"))
    groups, _ = scratch.cut(groups)
    short = found.select("doc", "own", "first", "n", "hash", "place")
    alone = short.join(groups.filter("texts = 1").select("hash", "stays"), "hash")
    several = groups.filter("texts > 1").select("hash")
    if not several.isEmpty():
        mixed = found.join(several, "hash", "left_semi")
        alone = alone.unionByName(mixed.join(
            mixed.groupBy("hash", "chunk").agg(F.min("place").alias("stays")), ["hash", "chunk"]
        ).drop("chunk"))
    gone, _ = scratch.cut(
        alone.filter("place <> stays").groupBy("doc", "own")
        .agg(F.array_sort(F.collect_set(F.struct("first", "n"))).alias("ranges")))
    lines = lines_of(F.col(f"row.`{text}`"))
    return (
        # The list of ranges grows with the corpus: one plan for every size.
        marked.join(gone.hint("merge"), ["doc", "own"], "left")
        .select(
            "row",
            F.when(F.col("ranges").isNull(), F.coalesce(F.col(f"row.`{text}`"), F.lit("")))
            .otherwise(let(lines, lambda own_lines: F.array_join(
                without(own_lines, F.col("ranges")), "\n"))).alias("kept_text"),
            F.size(lines).cast("long").alias("n_lines"),
            F.coalesce(F.aggregate(
                "ranges", F.lit(0).cast("long"), lambda total, r: total + r["n"]),
                F.lit(0).cast("long")).alias("n_removed"))
        .select("row.*", "kept_text", "n_lines", "n_removed"))
