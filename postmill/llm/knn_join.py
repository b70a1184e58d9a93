"""Exact top-k by inner product: a kNN join over Voronoi groups."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Pivots at least and at most, rows per pivot squared, and the expected number of rows that
#: one pivot is drawn from.
PIVOTS = (16, 512)
ROWS_PER_PIVOT = 4096
SAMPLE_ROWS = 64
#: Rings of equal width that a group's distances are counted in.
RINGS = 16
#: Queries or data rows per block; a pair of blocks is one step of a task.
BLOCK_ROWS = 4096
#: Query blocks whose answers a task holds at a time.
HELD_BLOCKS = 32
#: Room for rounding in the bounds, relative to the length of the longest vector.
SLACK = 1e-6


def lift(rows: np.ndarray, longest: float) -> np.ndarray:
    """One more component that brings every data row to the squared length ``longest``.

    With 0 in that place of a query, a larger inner product is a smaller distance.
    """
    rest = np.maximum(longest - (rows * rows).sum(axis=1), 0)
    return np.column_stack([rows, np.sqrt(rest)])


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (points * points).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)
    return np.sqrt(np.maximum(square - 2 * points @ pivots.T, 0))


def spread_out(points: np.ndarray, count: int) -> np.ndarray:
    """Pivots: from the first point on, always the one farthest from those chosen."""
    chosen = [0]
    near = distances(points, points[:1])[:, 0]
    while len(chosen) < min(count, len(points)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows.

    By matrix product where the size of the components shows that every partial sum is a
    whole number the float type holds, else in Python's own integers.
    """
    most = float(np.abs(queries.astype(float)).sum(axis=1).max()) * float(
        np.abs(rows.astype(float)).max(initial=0))
    if most < 2 ** 24:
        return (queries.astype(np.float32) @ rows.astype(np.float32).T).astype(np.int64)
    if most < 2 ** 53:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return queries.astype(object) @ rows.astype(object).T


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores, ties to the smaller id."""
    near = np.arange(len(scores))
    if len(scores) > k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def bound(away: np.ndarray, high: float, rings: dict[str, np.ndarray], rows: int) -> float:
    """A distance within which each query of a block is sure to have ``rows`` data rows.

    ``away``: from the block's pivot to every pivot; ``high``: the block's farthest query from
    its own pivot. A row of a ring is never farther than the way over both pivots.
    """
    far = away[rings["pivot"]] + high + rings["high"]
    order = np.argsort(far, kind="stable")
    enough = np.searchsorted(np.cumsum(rings["n"][order]), rows)
    return float(far[order[enough]]) if enough < len(order) else float("inf")


def whole_vectors(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """``id, row``: ``floor(scale * x)`` of the rows that take part."""
    x = F.col(f"`{vector}`")
    finite = F.forall(x, lambda v: F.coalesce(
        ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")), F.lit(False)))
    return vectors.filter(F.col(f"`{key}`").isNotNull() & x.isNotNull() & finite).select(
        F.col(f"`{key}`").cast("long").alias("id"),
        F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("row"))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def pivots_for(rows: int) -> int:
    """Pivots for so many rows: they follow the root of the number, within ``PIVOTS``."""
    return min(PIVOTS[1], max(PIVOTS[0], math.isqrt(rows // ROWS_PER_PIVOT)))


def top_k(
    vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 10, key: str = "vec_id",
    vector: str = "embedding", scale: int = 1024, pivots: int | None = None,
    block_rows: int = BLOCK_ROWS, report: Callable[[DataFrame, DataFrame], None] | None = None,
) -> DataFrame:
    """``query_id, rank, id, score``: each query's ``k`` best other rows by inner product.

    Components count as ``floor(scale * x)``. Every vector gets one more component so that a
    larger product is a smaller distance (``lift``). Then:

    1. Rows join the group of their nearest pivot; pivots follow the number of rows
       (``pivots_for``) and come from a sample of about ``SAMPLE_ROWS`` rows each. A group's
       summary is the count and the farthest row of each of its ``RINGS`` rings of distance;
       summaries are few whatever the data.
    2. Rows are gathered in blocks of about ``block_rows`` rows: a ring is cut by distance into
       thinner ones, and only those that are still larger, of rows at one distance, by hash.
    3. A query block's bound follows from the summaries alone (``bound``). A data block goes
       to it only if some row of its range of distances can lie within the bound, by the
       triangle inequality over both pivots.
    4. Pairs of blocks are solved by matrix product. A task hands on ``k`` rows per query,
       which are merged with a map-side half.

    Ties go to the smaller id. A query is not its own answer, and neither are rows that share
    its id; equal vectors under other ids are. Rows that repeat an id all count, as answers
    and as queries of their own. Fewer rows than ``k`` give fewer answers. Null ids, null and
    empty vectors and vectors that hold null or non-finite components take no part, neither as
    queries nor as answers. Vectors of different lengths have no product: each length is
    solved by itself, one after another; lengths are taken to be few. An empty table gives an
    empty one; other columns are not read.

    ``report`` gets the pairs of blocks to solve and the blocks, for each length.
    """
    spark = vectors.sparkSession
    whole = whole_vectors(vectors, key, vector, scale)
    found = spark.createDataFrame([], "query_id bigint, rank int, id bigint, score bigint")
    lengths = whole.filter(F.size("row") > 0).groupBy(F.size("row").alias("width")).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.aggregate("row", F.lit(0.0), lambda s, v: s + v.cast("double") * v)).alias("square"),
        F.max(F.array_max(F.transform("row", F.abs))).alias("most"),
    ).orderBy("width").collect()
    for n, facts in enumerate(lengths):
        number = "int" if facts.most < 2 ** 31 else "bigint"
        rows = whole.filter(F.size("row") == facts.width).select(
            "id", F.col("row").cast(f"array<{number}>").alias("row"))
        own = _solved(
            rows, is_query, k, facts.width, number, facts.n, facts.square,
            pivots or pivots_for(facts.n), block_rows, report)
        found = own if n == 0 else found.unionByName(own)
    return found


def _solved(
    rows: DataFrame, is_query: Callable[[Column], Column], k: int, width: int, number: str,
    total: int, longest: float, pivots: int, block_rows: int,
    report: Callable[[DataFrame, DataFrame], None] | None,
) -> DataFrame:
    """``top_k`` among whole vectors of one length."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "knn")
    sample = SAMPLE_ROWS * pivots
    drawn = _matrix(
        rows.filter(F.pmod(F.xxhash64(F.lit("pivot"), "id"), F.lit(1 << 20))
                    <= F.lit(sample / total * (1 << 20)))
        .orderBy("id").limit(4 * sample).toArrow().column("row").combine_chunks(),
        width).astype(float)
    centres = spread_out(lift(drawn if len(drawn) else np.zeros((1, width)), longest), pivots)
    state = spark.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("row"), width).astype(float)
            query = batch.column("query").to_numpy(zero_copy_only=False)
            points = lift(x, longest)
            points[query, -1] = 0
            at = distances(points, state.value)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(at.argmin(axis=1).astype(np.int32)),
                 pa.array(at.min(axis=1))], [*batch.schema.names, "pivot", "far"])

    both = rows.withColumn("query", F.explode(F.when(
        is_query(F.col("id")), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    placed, placed_path = scratch.cut(both.mapInArrow(
        place, f"id bigint, row array<{number}>, query boolean, pivot int, far double"
    ).withColumn("place", F.monotonically_increasing_id()))
    most = placed.agg(F.max("far")).first()[0] or 1.0
    # Queries have no rings: each of their blocks meets whole blocks of data.
    parts_of = F.when(F.col("query"), 1).otherwise(RINGS)
    placed = placed.withColumn(
        "ring", F.least(F.floor(F.col("far") / most * parts_of).cast("int"), parts_of - 1))
    sizes = placed.groupBy("query", "pivot", "ring").agg(
        F.count(F.lit(1)).alias("n"), F.max("far").alias("high"))
    summary = sizes.filter(~F.col("query")).orderBy("pivot", "ring").toArrow()
    rings = {c: summary.column(c).to_numpy() for c in ("pivot", "n", "high")}
    thin = ["query", "pivot", "ring", "thin"]
    # At most two kinds times PIVOTS[1] times RINGS rows; thin rings are as many as blocks.
    thinner = placed.join(F.broadcast(sizes.drop("high")), thin[:3]).withColumn("thin", F.least(
        F.floor((F.col("far") / most * parts_of - F.col("ring")) * F.ceil(F.col("n") / block_rows)),
        F.ceil(F.col("n") / block_rows) - 1)).drop("n")
    crowds = thinner.groupBy(*thin).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block_rows)
    blocks, _ = scratch.cut(
        thinner.join(crowds, thin, "left")
        .withColumn("part", F.pmod(F.xxhash64("place"), F.ceil(F.coalesce("n", F.lit(1)) / block_rows)))
        .groupBy(*thin, "part")
        .agg(F.min("far").alias("low"), F.max("far").alias("high"),
             F.collect_list(F.struct("id", "row", "place")).alias("rows"))
        .withColumn("block", F.monotonically_increasing_id()))
    scratch.drop(placed_path)
    # A query's bound must hold enough rows besides all those that share its id.
    own = rows.filter(is_query(F.col("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    enough = k + (own.agg(F.max("n")).first()[0] or 0)
    between = distances(centres, centres)
    slack = SLACK * max(1.0, float(np.sqrt(longest)))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, pivot, low, high = [], [], [], []
            for own, home, far in zip(*(batch.column(c).to_pylist() for c in (
                    "block", "pivot", "high")), strict=True):
                away = between[home]
                within = bound(away, far, rings, enough) + slack
                for other in np.unique(rings["pivot"]).tolist():
                    block.append(own)
                    pivot.append(other)
                    low.append(away[other] - far - within)
                    high.append(away[other] + far + within)
            yield pa.RecordBatch.from_arrays(
                [pa.array(block, pa.int64()), pa.array(pivot, pa.int32()),
                 pa.array(low, pa.float64()), pa.array(high, pa.float64())],
                ["q_block", "pivot", "from", "to"])

    routes = (
        blocks.filter("query").select("block", "pivot", "high")
        .mapInArrow(reach, "q_block bigint, pivot int, from double, to double")
        .join(blocks.filter("NOT query").select("pivot", "block", "low", "high"), "pivot")
        .filter("high >= from AND low <= to").select("q_block", "block"))
    if report is not None:
        report(routes, blocks)
    pairs = (
        routes.join(blocks.select(F.col("block").alias("q_block"), F.col("rows").alias("queries")),
                    "q_block")
        .join(blocks.select("block", "rows"), "block"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict] = {}

        def answers(block: int) -> pa.RecordBatch:
            own = held.pop(block)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.full(len(i), q) for q, _, (i, _) in own]), pa.int64()),
                 pa.array(np.concatenate([np.full(len(i), p) for _, p, (i, _) in own]), pa.int64()),
                 pa.array(np.concatenate([i for _, _, (i, _) in own]), pa.int64()),
                 pa.array(np.concatenate([s for _, _, (_, s) in own]).astype(np.int64))],
                ["query_id", "place", "id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                ids, data = [], []
                places = batch.column("queries")[i].values.field("place").to_pylist()
                for side in ("queries", "rows"):
                    listed = batch.column(side)[i].values
                    ids.append(listed.field("id").to_numpy())
                    data.append(_matrix(listed.field("row"), width))
                scores = products(*data)
                block = batch.column("q_block")[i].as_py()
                before = held.get(block) or [
                    (q, p, (np.zeros(0, np.int64), scores[:0, 0]))
                    for q, p in zip(ids[0].tolist(), places, strict=True)]
                after = []
                for n, (query, place, (old_ids, old)) in enumerate(before):
                    near = np.flatnonzero(ids[1] != query)
                    near = near[best_of(scores[n][near], ids[1][near], k)]
                    all_ids = np.concatenate([old_ids, ids[1][near]])
                    all_scores = np.concatenate([old, scores[n][near]])
                    best = best_of(all_scores, all_ids, k)
                    after.append((query, place, (all_ids[best], all_scores[best])))
                held[block] = after
                if len(held) > HELD_BLOCKS:
                    yield answers(next(iter(held)))
        while held:
            yield answers(next(iter(held)))

    best = Window.partitionBy("query_id", "place").orderBy(F.col("score").desc(), "id")
    return (
        pairs.select("q_block", "queries", "rows")
        .mapInArrow(solve, "query_id bigint, place bigint, id bigint, score bigint")
        .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "id", "score"))
