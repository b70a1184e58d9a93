"""Near duplicates by SimHash: every pair of fingerprints compared, tile against tile."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_slices
from .components import connected

#: Fingerprints per tile; a comparison of two tiles is at most its square.
TILE_ROWS = 4096
#: Rows of a tile compared in one numpy step.
STRIP = 256


def fingerprint(text: str | None, width: int) -> int:
    """SimHash of one text, as a signed 64-bit number.

    Words are runs without ASCII white space, A-Z lowered; shingles are ``width`` words
    joined by a space, repeats included. Fewer words make one shingle, none give zero.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(width)], strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), "<u8")
    counts = np.zeros(64, np.int64)
    # Eight counters to a 64-bit lane: 255 rows of bits cannot overflow a byte.
    for start in range(0, len(hashes), 255):
        some = hashes[start:start + 255].view(np.uint8).reshape(-1, 8)
        lanes = np.unpackbits(some, axis=1).view(np.uint64).sum(axis=0, dtype=np.uint64)
        counts += lanes.view(np.uint8)
    return int(np.packbits(counts * 2 > len(hashes)).view("<i8")[0])


def fingerprints(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3,
) -> DataFrame:
    """``key, fp`` of every whole text; one narrow pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, text):
            yield pa.RecordBatch.from_arrays(
                [part.column(key), pa.array([fingerprint(t, width) for t in texts], pa.int64())],
                [key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, fp bigint")


def block_masks(blocks: int) -> list[int]:
    """Signed masks that cut 64 bits into ``blocks`` parts of nearly equal length."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def blocks_for(n: int, tile_rows: int = TILE_ROWS) -> int:
    """Fewest parts for which the fullest cell of evenly spread fingerprints fits a tile."""
    blocks, fullest = 4, 0.196 ** 4
    while blocks < 16 and n * fullest > tile_rows:
        blocks += 1
        fullest = float(np.prod([
            0.7979 / np.sqrt(bin(m & (1 << 64) - 1).count("1")) for m in block_masks(blocks)]))
    return blocks


def _cell(fp: Column, blocks: int, radius: int) -> Column:
    """The population counts of the parts as one number, with room for ``radius`` each way."""
    base = 64 // blocks + 2 + 2 * radius
    cell = F.lit(0).cast("long")
    for mask in block_masks(blocks):
        count = F.bit_count(fp.bitwiseAND(F.lit(mask)))
        cell = cell * base + count.cast("long") + radius
    return cell


def _steps(blocks: int, radius: int) -> list[int]:
    """Offsets of the cells within ``radius``, one of each pair of opposite ones, and 0.

    Each differing bit changes one population count by one, so fingerprints within
    ``radius`` bits lie in cells whose counts differ by ``radius`` in all at most.
    """
    base = 64 // blocks + 2 + 2 * radius
    found: set[tuple[int, ...]] = {(0,) * blocks}
    for _ in range(radius):
        found |= {
            (*v[:i], v[i] + d, *v[i + 1:])
            for v, i, d in product(found, range(blocks), (-1, 1))}
    return [sum(x * base ** (blocks - 1 - i) for i, x in enumerate(v))
            for v in sorted(found) if v >= (0,) * blocks]


def hook(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the groups of ``a[i]`` and ``b[i]``; ``parent`` holds each one's smallest member."""
    while len(a):
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        still = low < high
        a, b = a[still], b[still]
        np.minimum.at(parent, high[still], low[still])
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up


def compare_tiles(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the groups which pairs within ``radius`` bits form in two tiles.

    All pairs are compared by exclusive-or and bit count; the links handed on are a spanning
    forest of them, at most one per fingerprint, and join the same groups.
    """
    members = np.concatenate([left, right])
    parent = np.arange(len(members))
    for start in range(0, len(left), STRIP):
        strip = left[start:start + STRIP]
        near = np.bitwise_count(strip[:, None] ^ right[None, :]) <= radius
        i, j = np.nonzero(near)
        hook(parent, i + start, j + len(left))
    own = np.flatnonzero(parent != np.arange(len(members)))
    u, v = members[own], members[parent[own]]
    return u[u != v], v[u != v]


def links(nodes: DataFrame, radius: int, scratch: Scratch, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``u, v``: a spanning set of all links between distinct fingerprints ``fp``.

    Fingerprints are tiled by the population counts of their parts; a cell with more than
    ``tile_rows`` of them is cut into several tiles by hash. A pair of tiles whose counts
    differ beyond the radius is never formed; every other pair is one row of bounded size,
    which any task can take.
    """
    blocks = blocks_for(nodes.count(), tile_rows)
    cells = nodes.select("fp", _cell(F.col("fp"), blocks, radius).alias("cell"))
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    tiles, _ = scratch.cut(
        cells.join(sizes, "cell")
        .withColumn("cut", F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / tile_rows)))
        .groupBy("cell", "cut").agg(F.collect_list("fp").alias("fps")))
    steps = F.array(*[F.lit(s).cast("long") for s in _steps(blocks, radius)])
    left = tiles.select(
        F.col("cell").alias("home"), F.col("cut").alias("home_cut"), F.col("fps").alias("own"),
        F.explode(steps).alias("step"),
    ).withColumn("cell", F.col("home") + F.col("step"))
    pairs = left.join(tiles, "cell").filter("step <> 0 OR home_cut <= cut").select("own", "fps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for name in ("own", "fps"):
                column = batch.column(name)
                sides.append((
                    column.flatten().to_numpy(zero_copy_only=False).view(np.uint64),
                    np.concatenate([[0], np.cumsum(
                        column.value_lengths().to_numpy(zero_copy_only=False))])))
            (a, a_ends), (b, b_ends) = sides
            found = [
                compare_tiles(a[a_ends[i]:a_ends[i + 1]], b[b_ends[i]:b_ends[i + 1]], radius)
                for i in range(batch.num_rows)]
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([f[s] for f in found]).view(np.int64))
                     for s in (0, 1)], ["u", "v"])

    return pairs.mapInArrow(run, "u bigint, v bigint")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, radius: int = 2,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """``key, fp, component_id`` of every document.

    Documents are linked when their fingerprints differ in ``radius`` bits at most;
    ``component_id`` is the smallest key that links lead to, the document's own included.
    Equal fingerprints are one node, so copies cost nothing in the comparison.

    Null, empty and blank texts have fingerprint zero and are linked like any other. Null
    keys take a component like others but never name one unless alone. Rows that repeat a
    key each keep their row. An empty table gives an empty one; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints, _ = scratch.cut(fingerprints(docs, key, text, width))
    nodes, _ = scratch.cut(prints.groupBy("fp").agg(F.min(key).alias("first")))
    found, found_path = scratch.cut(links(nodes, radius, scratch, tile_rows))
    roots = connected(found, scratch).select(F.col("node").alias("fp"), "root")
    joined = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    named, _ = scratch.cut(joined.join(lowest, "root").select("fp", "component_id"))
    scratch.drop(found_path)
    return prints.join(named, "fp").select(key, "fp", "component_id")
