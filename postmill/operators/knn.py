"""Nearest postings by cosine similarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import MAX_TOP_K
from .filters import filter_sources

#: Vectors per block of a search with many queries.
BLOCK_ROWS = 4096
#: Queries that are sent to all tasks: their vectors and ``k`` answers each fit there.
FEW_QUERIES = 8192
#: Index rows that meet all of them at once.
SCAN_ROWS = 1024
#: Groups of tasks whose answers to a query are merged first.
MERGE_PARTS = 32


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays, summed in doubles."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(
            F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")),
            F.lit(0.0), lambda acc, v: acc + v)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def cosine_score(cos: Column) -> Column:
    """Similarity on a 0-1 scale, the way a cosine vector index reports it."""
    return (F.lit(1.0) + cos) / 2


def _best_rows(raw: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best rows: score descending, then id. NaN never qualifies."""
    rows = np.flatnonzero(~np.isnan(raw))
    if len(rows) > k:
        kth = np.partition(raw[rows], len(rows) - k)[len(rows) - k]
        rows = rows[raw[rows] >= kth]
    return rows[np.lexsort((ids[rows], -raw[rows]))][:k]


def _trim(rows: pa.RecordBatch, k: int) -> pa.RecordBatch:
    raw = rows.column("raw").to_numpy(zero_copy_only=False)
    ids = rows.column("vacancy_id").to_numpy(zero_copy_only=False)
    return rows.take(pa.array(_best_rows(raw, ids, k), pa.int64()))


def usable_vectors(
    index: DataFrame, width: int, vector: str = "embedding",
) -> tuple[DataFrame, DataFrame]:
    """``(usable, quarantine)``: vectors of ``width`` numbers, and all others.

    A null vector, another length and a null or NaN component are no vector to search.
    """
    good = (F.size(vector) == width) & F.forall(
        vector, lambda v: v.isNotNull() & ~F.isnan(v))
    good = F.coalesce(good, F.lit(False))
    return index.filter(good), index.filter(~good)


def _unit(vectors: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _scan_task(
    query: np.ndarray, k: int, keep: Sequence[str],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Score Arrow batches by matrix product; a task emits ``k`` rows at its end."""
    unit = _unit(query[None, :])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: pa.RecordBatch | None = None
        for batch in batches:
            vectors = _matrix(batch.column("embedding"), unit.shape[1])
            with np.errstate(invalid="ignore", divide="ignore"):
                scores = (1 + vectors @ unit[0] / np.linalg.norm(vectors, axis=1)) / 2
            found = _trim(pa.RecordBatch.from_arrays(
                [*[batch.column(name) for name in keep], pa.array(scores)], [*keep, "raw"]), k)
            if best is not None:
                both = pa.Table.from_batches([best, found]).combine_chunks()
                found = _trim(both.to_batches()[0], k) if both.num_rows else found
            best = found
        if best is not None and best.num_rows:
            yield best

    return scan


def _check_k(k: int) -> None:
    if not 1 <= k <= MAX_TOP_K:
        raise ValueError(f"k must be between 1 and {MAX_TOP_K}")


def knn_topk(
    index: DataFrame, query: Sequence[float], k: int, sources: Sequence[str] | None = None,
) -> DataFrame:
    """The ``k`` index rows nearest to one query vector, with ``raw`` score.

    Exact: one scan, no shuffle. Each Arrow batch is scored by one matrix product, each
    task emits its ``k`` best rows, and those are merged to ``k``. Keep ``index`` narrow and
    join titles to the hits. The source filter applies inside the search; everything else
    comes after the cut. A zero vector has no direction and is never a hit;
    ``usable_vectors`` tells which rows take no part.
    """
    _check_k(k)
    matrix = np.array(query, dtype=np.float64)
    keep = [c for c in index.columns if c != "embedding"]
    types = ", ".join(f"`{c}` {index.schema[c].dataType.simpleString()}" for c in keep)
    good, _ = usable_vectors(filter_sources(index, sources), len(matrix))
    return (
        good.select(*keep, "embedding")
        .mapInArrow(_scan_task(matrix, k, keep), f"{types}, raw double")
        .orderBy(F.col("raw").desc(), F.col("vacancy_id"))
        .limit(k)
    )


def _top_by_query(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of what the tasks found per query, merged in two levels."""
    best = [F.col("raw").desc(), F.col("vacancy_id")]
    part = F.pmod(F.spark_partition_id(), F.lit(MERGE_PARTS))
    first = Window.partitionBy("profile_id", "_part").orderBy(*best)
    return (
        found.withColumn("_part", part)
        .withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
        .withColumn("rank", F.row_number().over(Window.partitionBy("profile_id").orderBy(*best)))
        .filter(F.col("rank") <= k)
        .select("profile_id", "vacancy_id", "raw", "rank"))


def _answers(p_ids: np.ndarray, best: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array(np.repeat(p_ids, [len(ids) for ids, _ in best])),
        pa.array(np.concatenate([ids for ids, _ in best])),
        pa.array(np.concatenate([raw for _, raw in best]))], ["profile_id", "vacancy_id", "raw"])


def _better(
    before: list[tuple[np.ndarray, np.ndarray]], raw: np.ndarray, ids: np.ndarray, k: int,
) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each query's ``k`` best of those held before and of one more block's scores."""
    out = []
    for (old_ids, old), scores in zip(before, raw, strict=True):
        if len(old) == k:  # only what beats the last one held, or ties with it
            near = np.flatnonzero(scores >= old[-1])
            all_ids, all_raw = np.concatenate([old_ids, ids[near]]), np.concatenate([old, scores[near]])
        else:
            all_ids, all_raw = np.concatenate([old_ids, ids]), np.concatenate([old, scores])
        rows = _best_rows(all_raw, all_ids, k)
        out.append((all_ids[rows], all_raw[rows]))
    return out


def knn_topk_many(
    index: DataFrame, queries: DataFrame, k: int, width: int,
    sources: Sequence[str] | None = None, block_rows: int = BLOCK_ROWS,
    few_queries: int = FEW_QUERIES,
) -> DataFrame:
    """``profile_id, vacancy_id, raw, rank``: top ``k`` for every row of ``queries``.

    ``queries`` holds ``profile_id`` and ``embedding``; ``width`` is the length of a vector.
    Up to ``few_queries`` of them go to every task of one scan of the index: it is read once
    and not shuffled, a block of it meets all queries in one matrix product, and a task hands
    on ``k`` rows per query. More are gathered in blocks of about ``block_rows``, as is the
    index, and each pair of blocks is one row of work; then neither side passes through the
    driver or one task. Both ways merge in two levels.
    """
    _check_k(k)
    held = usable_vectors(filter_sources(index, sources), width)[0].select("vacancy_id", "embedding")
    good = usable_vectors(queries, width)[0].select("profile_id", "embedding")
    few = good.limit(few_queries + 1).toArrow() if few_queries else None
    if few is not None and few.num_rows <= few_queries:
        rows = few.combine_chunks()
        ids = rows["profile_id"].to_numpy()
        state = index.sparkSession.sparkContext.broadcast(
            (ids, _unit(_matrix(rows["embedding"].combine_chunks(), width)) if len(ids) else None))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p_ids, p = state.value
            best = [(np.zeros(0, np.int64), np.zeros(0))] * len(p_ids)
            for batch in batches if len(p_ids) else ():
                for at in range(0, batch.num_rows, SCAN_ROWS):
                    block = batch.slice(at, SCAN_ROWS)
                    own = _unit(_matrix(block.column("embedding"), width))
                    best = _better(best, (1 + p @ own.T) / 2, block.column("vacancy_id").to_numpy(
                        zero_copy_only=False), k)
            if any([len(found) for found, _ in best]):
                yield _answers(p_ids, best)

        return _top_by_query(
            held.mapInArrow(scan, "profile_id bigint, vacancy_id bigint, raw double"), k)

    def blocks(df: DataFrame, key: str, name: str) -> tuple[DataFrame, int]:
        number = max(1, -(-df.count() // block_rows))
        block = F.pmod(F.xxhash64(key), F.lit(number)).cast("int").alias(f"{name}_block")
        rows = F.collect_list(F.struct(F.col(key).alias("id"), F.col("embedding")))
        return df.groupBy(block).agg(rows.alias(name)), number

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (p_ids, p), (ids, rows) = [
                    (side.field("id").to_numpy(), _unit(_matrix(side.field("embedding"), width)))
                    for side in (batch.column(c)[i].values for c in ("asked", "held"))]
                none = [(np.zeros(0, np.int64), np.zeros(0))] * len(p_ids)
                best = _better(none, (1 + p @ rows.T) / 2, ids, k)
                if any([len(found) for found, _ in best]):
                    yield _answers(p_ids, best)

    blocked, number = blocks(held, "vacancy_id", "held")
    asked, _ = blocks(good, "profile_id", "asked")
    pairs = asked.withColumn(
        "held_block", F.explode(F.sequence(F.lit(0), F.lit(number - 1)))).join(
            blocked.hint("merge"), "held_block")  # sizes of arrays are guessed far too low to broadcast by
    return _top_by_query(pairs.select("asked", "held").mapInArrow(
        solve, "profile_id bigint, vacancy_id bigint, raw double"), k)
