"""Fill-in-the-middle texts, cut at token boundaries found by a learned rank index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, SLICE_ROWS

#: Farthest that a boundary may lie from its segment's line, in bytes; residuals fit 8 bits.
BOUND = 100
#: Boundaries of the longest segments; a segment off its line is halved.
LONGEST = 1024
#: Marks before prefix, suffix and middle. A text that holds one is left as it is.
MARKS = ("<P>", "<S>", "<M>")
#: White space between tokens: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass
class RankIndex:
    """Rising offsets by rank: lines over runs of ranks, and how far each offset is off.

    ``first`` holds the first rank of every segment, ``base`` the offset there, ``step`` the
    rise per rank, ``off`` a residual of one byte per rank. ``at`` is exact.
    """

    first: np.ndarray
    base: np.ndarray
    step: np.ndarray
    off: np.ndarray

    @classmethod
    def fit(cls, offsets: np.ndarray, bound: int = BOUND, longest: int = LONGEST) -> RankIndex:
        """Segments whose line, from first to last offset, is nowhere off by more than ``bound``.

        Runs of ``longest`` ranks are halved where they are off their line, all at once per
        round. A run of two ranks is never off, so it ends.
        """
        n = len(offsets)
        starts = np.arange(0, n, longest)
        kept = []
        while len(starts):
            ends = np.minimum(starts + longest, n)
            sizes = ends - starts
            base = offsets[starts]
            step = (offsets[ends - 1] - base) / np.maximum(sizes - 1, 1)
            own = np.repeat(np.arange(len(starts)), sizes)
            rank = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            off = offsets[starts[own] + rank] - base[own] - np.rint(step[own] * rank).astype(np.int64)
            wrong = np.zeros(len(starts), bool)
            wrong[own[np.abs(off) > bound]] = True
            kept.append((starts[~wrong], base[~wrong], step[~wrong]))
            longest //= 2
            starts = (starts[wrong][:, None] + [0, longest]).ravel()
            starts = starts[starts < np.repeat(ends[wrong], 2)]
        first, base, step = (np.concatenate(c) for c in zip(*kept, strict=True)) if kept else (
            np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.argsort(first, kind="stable")
        index = cls(first[order], base[order], step[order], np.zeros(n, np.int8))
        index.off = (offsets - index.predict(np.arange(n))).astype(np.int8)
        return index

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        own = np.searchsorted(self.first, ranks, "right") - 1
        return self.base[own] + np.rint(self.step[own] * (ranks - self.first[own])).astype(np.int64)

    def at(self, ranks: np.ndarray) -> np.ndarray:
        """The offsets of ``ranks``: predicted by their segments, put right by their residuals."""
        return self.predict(ranks) + self.off[ranks]


def boundaries(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of every boundary of texts that lie one after another in ``raw``; tokens per text.

    A token is white space, if any, and the word after it; white space at the end of a text is
    a token as well. A text of n tokens has n + 1 boundaries, its start and end among them.
    """
    word = ~SPACE[raw]
    last = np.zeros(len(raw) + 1, bool)
    last[1:-1] = word[:-1] & ~word[1:]
    filled = ends > starts
    last[starts[filled]] = False
    last[ends[filled]] = True
    after = np.flatnonzero(last)
    tokens = np.searchsorted(after, ends, "right") - np.searchsorted(after, starts, "right")
    # Every text's start stands before its token ends.
    return np.insert(after, np.cumsum(tokens) - tokens, starts), tokens


def _characters(raw: bytes) -> int:
    return int((np.frombuffer(raw, np.uint8) & 0xC0 != 0x80).sum())


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Arrow batches in short slices of bounded bytes, unless one row alone has more."""
    for batch in batches:
        sizes = np.diff(_offsets(batch.column(column)))
        start = 0
        while start < batch.num_rows:
            fitting = int(np.searchsorted(np.cumsum(sizes[start:start + SLICE_ROWS]), SLICE_BYTES, "right"))
            stop = start + max(1, fitting)
            yield batch.slice(start, stop - start)
            start = stop


def _offsets(column: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(column.type)
    return np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[
        column.offset:column.offset + len(column) + 1].astype(np.int64)


def restored(output: Column, form: Column) -> Column:
    """The text that a transformed ``output`` was made of."""
    part = F.split(output, "<[PSM]>", 4)
    return (
        F.when(form == "psm", F.concat(F.get(part, F.lit(1)), F.get(part, F.lit(3)), F.get(part, F.lit(2))))
        .when(form == "spm", F.concat(F.get(part, F.lit(2)), F.get(part, F.lit(3)), F.get(part, F.lit(1))))
        .otherwise(output))


def fill_in_middle(
    docs: DataFrame, seed: int = 42, plain_from: int = 50, spm_below: int = 80,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``key, n, form, prefix_chars, middle_chars, output`` of every whole text.

    Four numbers come from the first 32 digits of the SHA-256 of ``seed:key``. The first two,
    modulo ``n + 1`` over the ``n`` tokens (``boundaries``), are the ranks of the two cuts;
    prefix and middle end there. A text is ``plain``, unchanged, if it is empty, holds one of
    ``MARKS``, or the third number modulo 100 is ``plain_from`` or more. Otherwise the fourth,
    modulo 100, makes it ``spm`` (``<S>`` suffix ``<P>`` prefix ``<M>`` middle) below
    ``spm_below``, else ``psm`` (``<P>`` prefix ``<S>`` suffix ``<M>`` middle). ``restored``
    is the way back.

    The boundaries of the texts of a slice go into one ``RankIndex``, which gives the cuts.
    Offsets are bytes; lengths are counted in code points. Null texts count as empty; a null
    key hashes as an empty id. Rows are independent, so repeated rows stay and fare alike; an
    empty table gives an empty one. One narrow pass, no shuffle; other columns are not read.
    """
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), 256)
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    marked = F.lit(False)
    for mark in MARKS:
        marked = marked | F.contains(value, F.lit(mark))
    number = [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    form = F.when((value == "") | marked | (number[2] % 100 >= plain_from), "plain").when(
        number[3] % 100 < spm_below, "spm").otherwise("psm")
    rows = docs.select(
        F.col(f"`{key}`").alias("key"), value.alias("text"), form.alias("form"),
        number[0].alias("h1"), number[1].alias("h2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            column = part.column("text")
            ends = _offsets(column)
            data = column.buffers()[2]
            raw = memoryview(data)[ends[0]:ends[-1]] if data is not None else memoryview(b"")
            ends = ends - ends[0]
            offsets, n = boundaries(np.frombuffer(raw, np.uint8), ends[:-1], ends[1:])
            index = RankIndex.fit(offsets)
            first = np.cumsum(n + 1) - (n + 1)
            h1, h2 = (part.column(c).to_numpy() % (n + 1) for c in ("h1", "h2"))
            low, high = index.at(first + np.minimum(h1, h2)), index.at(first + np.maximum(h1, h2))
            prefix_chars, middle_chars, out = [], [], []
            for i, form in enumerate(part.column("form").to_pylist()):
                start, end = ends[i], ends[i + 1]
                if form == "plain":
                    prefix_chars.append(None)
                    middle_chars.append(None)
                    out.append(bytes(raw[start:end]))
                    continue
                prefix, middle, suffix = (
                    bytes(raw[a:b]) for a, b in ((start, low[i]), (low[i], high[i]), (high[i], end)))
                prefix_chars.append(_characters(prefix))
                middle_chars.append(_characters(middle))
                out.append(b"<S>%b<P>%b<M>%b" % (suffix, prefix, middle) if form == "spm"
                           else b"<P>%b<S>%b<M>%b" % (prefix, suffix, middle))
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), pa.array(n, pa.int64()), part.column("form"),
                 pa.array(prefix_chars, pa.int64()), pa.array(middle_chars, pa.int64()),
                 pa.array(out, pa.binary()).cast(pa.string())],
                [key, "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(
        run, f"`{key}` {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, "
             "output string")
