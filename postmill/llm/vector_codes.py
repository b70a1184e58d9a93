"""Product codes of vectors: codebooks by exact integer k-means, one index per part."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Whole numbers up to this many bits are exact in float64.
FLOAT_BITS = 53
#: Bits of the limbs that sums travel in, so that Spark's long sums hold them for any data.
SUM_BITS = 40
#: Rows compared with a codebook at once.
BLOCK_ROWS = 4096
#: Copies of every total in the join back, so that a frequent value is not one task's work.
SALTS = 16
MOST_LONG = (1 << 63) - 1


def limbs(numbers: np.ndarray, bits: int) -> list[np.ndarray]:
    """``numbers`` in base ``2 ** bits``, lowest first, as floats; the last limb has the sign."""
    out = []
    while len(numbers) and max(int(numbers.max()), -int(numbers.min())) >= 1 << bits:
        out.append((numbers & ((1 << bits) - 1)).astype(np.float64))
        numbers = numbers >> bits
    return [*out, numbers.astype(np.float64)]


def exact_products(left: np.ndarray, right: np.ndarray, bits: int | None = None) -> np.ndarray:
    """``left @ right.T`` of 64-bit integers, exact wherever the result is one too.

    Limbs are short enough (``bits``) that every sum of a float64 matrix product stays below
    ``2 ** 53``; the products of limbs are put together by shifts in int64, where what runs
    over on the way comes back.
    """
    width = left.shape[1]
    if bits is None:
        bits = (FLOAT_BITS - max(width - 1, 1).bit_length()) // 2
    out = np.zeros((len(left), len(right)), np.int64)
    if not width or not len(left) or not len(right):
        return out
    for i, a in enumerate(limbs(left, bits)):
        for j, b in enumerate(limbs(right, bits)):
            if bits * (i + j) < 64:
                out += (a @ b.T).astype(np.int64) << (bits * (i + j))
    return out


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest entry, the first of several, and its squared distance.

    In 64-bit integers where the size of the numbers shows that all fits, else in Python's.
    """
    most = max(abs(int(v)) for a in (rows, book) for v in ((a.max(), a.min()) if a.size else (0,)))
    if 4 * max(1, rows.shape[1]) * most * most < 1 << 62:
        rows, book = rows.astype(np.int64), book.astype(np.int64)
        cost = (book * book).sum(axis=1) - 2 * exact_products(rows, book)
    else:
        rows, book = rows.astype(object), book.astype(object)
        cost = (book * book).sum(axis=1) - 2 * (rows @ book.T)
    code = cost.argmin(axis=1)
    return code, cost[np.arange(len(rows)), code] + (rows * rows).sum(axis=1)


def parts_of(width: int, parts: int) -> list[slice]:
    """Consecutive parts; where ``parts`` does not divide ``width`` the first ones are one longer."""
    cuts = [0]
    for i in range(parts):
        cuts.append(cuts[-1] + width // parts + (i < width % parts))
    return [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


@dataclass
class Codebooks:
    """``books[width][part]``: the entries of a part of vectors of that length."""

    scale: int = 1024
    parts: int = 4
    books: dict[int, list[np.ndarray]] = field(default_factory=dict)

    def listed(self) -> list[int]:
        """All components by length of vector, part, entry and position."""
        return [int(v) for _, books in sorted(self.books.items()) for b in books for v in b.ravel()]


def whole_rows(lists: pa.Array, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and ``floor(scale * x)`` of the vectors that take part, by length and block.

    Vectors that are null or hold null or non-finite components take no part, nor do those
    whose scaled components leave the float range.
    """
    if pa.types.is_fixed_size_list(lists.type):
        lists = lists.cast(pa.list_(lists.type.value_type))
    sizes = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        flat = np.floor(flat * scale)
    starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    for width in np.unique(sizes[sizes >= 0]).tolist():
        own = np.flatnonzero(sizes == width)
        for at in range(0, len(own), BLOCK_ROWS):
            block = own[at:at + BLOCK_ROWS]
            rows = flat[starts[block][:, None] + np.arange(width)]
            fit = np.isfinite(rows).all(axis=1)
            rows = rows[fit]
            if rows.size and np.abs(rows).max() >= 2.0 ** 62:
                whole = np.array([[int(v) for v in row] for row in rows.tolist()], object)
            else:
                whole = rows.astype(np.int64)
            if len(rows):
                yield block[fit], whole.reshape(len(rows), width)


def _sums_by(code: np.ndarray, rows: np.ndarray, total: dict[int, list]) -> None:
    """Add counts and component sums of every entry to ``total``, in Python's integers."""
    if rows.dtype != object and rows.size and np.abs(rows).max() >= 1 << 50:
        rows = rows.astype(object)
    order = np.argsort(code, kind="stable")
    entries, first, count = np.unique(code[order], return_index=True, return_counts=True)
    sums = np.add.reduceat(rows[order], first, axis=0) if rows.shape[1] else rows[first]
    for entry, n, row in zip(entries.tolist(), count.tolist(), sums.tolist(), strict=True):
        before = total.get(entry)
        total[entry] = [n, *row] if before is None else [
            a + b for a, b in zip(before, [n, *row], strict=True)]


def _first_entries(
    vectors: DataFrame, books: Codebooks, entries: int, key: str, vector: str,
) -> dict[int, list[np.ndarray]]:
    """The rows of the smallest keys, by length of vector."""
    scale = books.scale

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").fill_null(MOST_LONG).to_numpy(zero_copy_only=False)
            for at, rows in whole_rows(batch.column("row"), scale):
                own = ids[at]
                if len(own) > entries:
                    few = own <= np.partition(own, entries - 1)[entries - 1]
                    at, rows = at[few], rows[few]
                flat = pa.array(rows.astype(np.float64).ravel())
                ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(at)), pa.ListArray.from_arrays(ends, flat)],
                    ["id", "row"])

    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("row"))
    out = {}
    widths = rows.filter("row IS NOT NULL").select(F.size("row").alias("n")).distinct().collect()
    for width in sorted(w.n for w in widths):
        first = (
            rows.filter(F.size("row") == width).mapInArrow(smallest, "id bigint, row array<double>")
            .orderBy(F.col("id").asc_nulls_last(), "row").limit(entries).collect())
        if first:
            whole = np.array([[int(v) for v in r.row] for r in first], object).reshape(
                len(first), width)
            out[width] = [whole[:, part] for part in parts_of(width, books.parts)]
    return out


def train_codebooks(
    vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024,
    key: str = "vec_id", vector: str = "embedding",
) -> Codebooks:
    """Codebooks by ``rounds`` of k-means over all vectors, in whole numbers.

    Components count as ``floor(scale * x)``; a vector is cut into ``parts`` equal consecutive
    parts (``parts_of`` where the length does not divide). Each part's book starts as that
    part of the ``entries`` smallest keys, equal keys by their components, null keys last;
    fewer rows give shorter books. A round puts every part to its nearest entry, the first of
    several, and every entry in use in the middle of its parts, rounded down.

    Each round is one pass: a task adds up its own rows per entry, and what Spark adds up and
    the driver gets are ``parts * entries`` rows of sums, whatever the data. Only ids and
    vectors of the first entries are collected besides.

    Null vectors and those with null or non-finite components take no part. Vectors of
    another length have books of their own; lengths are taken to be few. An empty table gives
    no books.
    """
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("a code is one byte per part")
    spark = vectors.sparkSession
    books = Codebooks(scale, parts)
    books.books = _first_entries(vectors, books, entries, key, vector)
    mask = (1 << SUM_BITS) - 1
    rows = vectors.select(F.col(f"`{vector}`").alias("row"))
    for _ in range(rounds if books.books else 0):
        state = spark.sparkContext.broadcast(books)

        def add(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            own, totals = state.value, {}
            for batch in batches:
                for _, rows in whole_rows(batch.column("row"), own.scale):
                    width = rows.shape[1]
                    for n, part in enumerate(parts_of(width, own.parts)):
                        code, _ = nearest(rows[:, part], own.books[width][n])
                        _sums_by(code, rows[:, part], totals.setdefault((width, n), {}))
            out = []
            for (width, n), total in totals.items():
                for entry, sums in total.items():
                    for place, value in enumerate(sums):
                        limb = 0
                        while not -1 - mask <= value <= mask:
                            out.append((width, n, entry, place, limb, value & mask))
                            value, limb = value >> SUM_BITS, limb + 1
                        out.append((width, n, entry, place, limb, value))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c, pa.int32()) for c in columns[:5]], pa.array(columns[5], pa.int64())],
                ["width", "part", "entry", "place", "limb", "value"])

        added = (
            rows.mapInArrow(add, "width int, part int, entry int, place int, limb int, value bigint")
            .groupBy("width", "part", "entry", "place", "limb").agg(F.sum("value").alias("value"))
            .collect())
        sums: dict[tuple, int] = {}
        for r in added:
            at = (r.width, r.part, r.entry, r.place)
            sums[at] = sums.get(at, 0) + (r.value << (SUM_BITS * r.limb))
        moved = {w: [b.copy() for b in own] for w, own in books.books.items()}
        for (width, part, entry, place), total in sums.items():
            if place:
                moved[width][part][entry, place - 1] = total // sums[width, part, entry, 0]
        books = Codebooks(scale, parts, moved)
    return books


def encode_vectors(
    vectors: DataFrame, books: Codebooks, key: str = "vec_id", vector: str = "embedding",
    keep: list[str] | None = None,
) -> DataFrame:
    """``key``, the columns ``keep``, ``code`` (one byte per part) and ``error`` of every vector.

    ``error`` is the sum of the squared distances of the parts to their entries, at most the
    largest long. Vectors that take no part in training, or whose length has no book, are left
    out; repeated rows and null keys stay. An empty table gives an empty one. One narrow pass.
    """
    names = [key, *(keep or [])]
    state = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = state.value
        for batch in batches:
            for at, rows in whole_rows(batch.column("row"), own.scale):
                held = own.books.get(rows.shape[1])
                if held is None:
                    continue
                codes, error = [], 0
                for part, book in zip(parts_of(rows.shape[1], own.parts), held, strict=True):
                    code, away = nearest(rows[:, part], book)
                    codes.append(code.astype(np.uint8))
                    error = error + away.astype(object)
                taken = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [*[taken.column(i) for i in range(len(names))],
                     pa.array([c.tobytes() for c in np.column_stack(codes)], pa.binary()),
                     pa.array([min(int(e), MOST_LONG) for e in error], pa.int64())],
                    [*names, "code", "error"])

    kinds = ", ".join(f"`{n}` {vectors.schema[n].dataType.simpleString()}" for n in names)
    return vectors.select(
        *[F.col(f"`{n}`") for n in names], F.col(f"`{vector}`").alias("row"),
    ).mapInArrow(run, f"{kinds}, code binary, error bigint")


def with_total(rows: DataFrame, of: str, by: str, name: str, key: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``of`` over all rows of equal ``by``, nulls together.

    Sums are made map-side first. They grow with the values of ``by``, so they are joined by
    sort-merge at every size, in ``SALTS`` copies: rows of a frequent value are spread by the
    hash of ``key``. A sum beyond the largest long is that.
    """
    long: Callable[[Column], Column] = lambda c: F.least(
        c, F.lit(MOST_LONG).cast("decimal(38,0)")).cast("long")
    salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("_salt")
    totals = rows.groupBy(F.col(by).alias("_by")).agg(
        long(F.sum(F.col(of).cast("decimal(38,0)"))).alias(name)).select("_by", name, salts)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(key, of), F.lit(SALTS)).cast("int"))
    return salted.join(
        totals.hint("merge"),
        salted[by].eqNullSafe(totals["_by"]) & (salted["_salt"] == totals["_salt"]),
    ).select(*rows.columns, name)
