"""Passages repeated across documents, by seed and extend over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import Recent
from .common import Scratch, per_worker, text_slices

#: Words of a repeat that counts.
WINDOW = 50
#: Words of an anchor.
ANCHOR = 16
#: Words per generation of a worker's cache of hashes.
CACHED = 200_000
#: Odd multipliers of the two rolling hashes over words, and the shifts and factors of the
#: final mixing step.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
MIX = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB))


def words_of(text: str | None) -> list[bytes]:
    """Runs without ASCII white space, unchanged."""
    return text.encode().split() if text else []


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, factor in MIX:
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


class Rolling:
    """Two independent 64-bit hashes of any run of words, from prefix sums.

    Each rolls over its own half of the words' 128-bit hashes.
    """

    def __init__(self):
        self.words = Recent(xxhash.xxh3_128_digest, CACHED)
        self.up = self.down = np.zeros((2, 0), np.uint64)

    def _powers(self, n: int) -> None:
        if self.up.shape[1] < n:
            n = max(n, 2 * self.up.shape[1], 1024)
            rows = []
            for base in (*BASES, *(pow(b, -1, 1 << 64) for b in BASES)):
                row = np.full(n, base, np.uint64)
                row[0] = 1
                rows.append(np.multiply.accumulate(row))
            self.up, self.down = np.stack(rows[:2]), np.stack(rows[2:])

    def read(self, words: list[bytes]) -> None:
        n = len(words)
        self._powers(n + 1)
        halves = np.frombuffer(b"".join(map(self.words.__getitem__, words)), "<u8").reshape(n, 2).T
        self.sums = np.zeros((2, n + 1), np.uint64)
        np.cumsum(halves * self.up[:, :n], axis=1, out=self.sums[:, 1:])

    def runs(self, start: np.ndarray, stop: np.ndarray, which: int) -> np.ndarray:
        """Hash ``which`` of words ``start[i]`` to ``stop[i]``; 128 bits with both."""
        sums = self.sums[which]
        return _mixed((sums[stop] - sums[start]) * self.down[which][start])


def seeds(rolling: Rolling, n: int, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Anchors of ``n`` words: hash, first window that chose it, end of its last window.

    Every window of ``window`` words chooses the leftmost smallest hash among its runs of
    ``anchor`` words. The choice depends on the window's words alone, so a passage shared by
    two documents has the same anchors in both; a chosen anchor serves neighbouring windows.
    """
    at = np.arange(n - anchor + 1)
    hashes = rolling.runs(at, at + anchor, 0)
    spread = window - anchor + 1
    chosen = np.lib.stride_tricks.sliding_window_view(hashes, spread).argmin(axis=1)
    chosen += np.arange(len(chosen))
    first = np.flatnonzero(np.diff(chosen, prepend=-1))
    last = np.append(first[1:], len(chosen))
    return hashes[chosen[first]], first, last - 1 + window


def _rolling(state) -> Rolling:
    return per_worker(state, "rolling", lambda _: Rolling())


def _span(start: np.ndarray, stop: np.ndarray) -> pa.Array:
    return pa.array(start.astype(np.int64) << 32 | stop.astype(np.int64))


def _signed(h: list[np.ndarray]) -> pa.Array:
    return pa.array(np.concatenate([x.view(np.int64) for x in h]))


def repeats(
    docs: DataFrame, scratch: Scratch, window: int = WINDOW, anchor: int = ANCHOR,
) -> DataFrame:
    """``doc, hash, spans``: word ranges of ``docs(doc, hash, text)`` that also start in a smaller doc.

    1. Seed: every document's anchors, each with the words of the windows that chose it.
    2. Join: only anchors found in two documents or more go on.
    3. Extend: an anchor's windows reach to both sides of it. Occurrences of one anchor with
       the same reach are one class; all of its members but the smallest document repeat
       that whole reach. Where an anchor has several classes, the smallest document of each
       is extended window by window, and a window's smallest document is found by its hash.
    4. The ranges that overlap make up the maximal repeats.

    No pairs of occurrences are formed: classes and windows are aggregates with a map-side
    half, joined back to the occurrences, so a passage that most documents share is neither
    one task's work nor quadratic. Words are compared by two independent 64-bit rolling
    hashes of the window, 128 bits in all.
    """
    state = docs.sparkSession.sparkContext.broadcast({})
    kind = docs.schema["doc"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = _rolling(state)
        for part, texts in text_slices(batches, "text"):
            rows, marks, one, two, start, stop = [], [], [], [], [], []
            for i, text in enumerate(texts):
                words = words_of(text)
                if len(words) < window:
                    continue
                rolling.read(words)
                marked, first, last = seeds(rolling, len(words), window, anchor)
                rows.append(np.full(len(first), i))
                marks.append(marked)
                one.append(rolling.runs(first, last, 0))
                two.append(rolling.runs(first, last, 1))
                start.append(first)
                stop.append(last)
            if rows:
                own = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([
                    part.column("doc").take(own), part.column("hash").take(own),
                    _signed(marks), _signed(one), _signed(two),
                    _span(np.concatenate(start), np.concatenate(stop)),
                ], ["doc", "hash", "mark", "one", "two", "span"])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = _rolling(state)
        for part, texts in text_slices(batches, "text"):
            rows, one, two, start = [], [], [], []
            for i, (text, spans) in enumerate(zip(texts, part.column("spans"), strict=True)):
                words = words_of(text)
                rolling.read(words)
                spans = np.asarray(spans.values, np.int64)
                inside = np.zeros(len(words) + 1, np.int64)
                np.add.at(inside, spans >> 32, 1)
                np.add.at(inside, (spans & 0xFFFFFFFF) - window + 1, -1)
                first = np.flatnonzero(np.cumsum(inside))
                rows.append(np.full(len(first), i))
                one.append(rolling.runs(first, first + window, 0))
                two.append(rolling.runs(first, first + window, 1))
                start.append(first)
            if rows:
                own, first = pa.array(np.concatenate(rows)), np.concatenate(start)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc").take(own), part.column("hash").take(own),
                    _signed(one), _signed(two), _span(first, first + window),
                ], ["doc", "hash", "one", "two", "span"])

    docs = docs.filter("doc IS NOT NULL")
    found, found_path = scratch.cut(docs.mapInArrow(
        find, f"doc {kind}, hash bigint, mark bigint, one bigint, two bigint, span bigint"))
    shared, shared_path = scratch.cut(
        found.groupBy("mark").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
        .filter("low < high").select("mark"))
    held, held_path = scratch.cut(found.join(shared, "mark", "left_semi"))
    scratch.drop(found_path, shared_path)
    reach = ["mark", "one", "two"]
    classes, _ = scratch.cut(held.groupBy(*reach).agg(F.min("doc").alias("low")))
    several, _ = scratch.cut(
        classes.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        .select("mark", F.lit(True).alias("mixed")))
    met, _ = scratch.cut(
        held.join(classes.join(several, "mark", "left"), reach)
        .filter("doc > low OR mixed")
        .select("doc", "hash", "span", (F.col("doc") > F.col("low")).alias("repeated")))
    scratch.drop(held_path)
    first = met.filter(~F.col("repeated")).groupBy("doc", "hash").agg(
        F.collect_list("span").alias("spans"))
    windows, _ = scratch.cut(docs.join(first, ["doc", "hash"]).mapInArrow(
        extend, f"doc {kind}, hash bigint, one bigint, two bigint, span bigint"))
    lowest, _ = scratch.cut(
        windows.groupBy("one", "two").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
        .filter("low < high").drop("high"))
    again = windows.join(lowest, ["one", "two"]).filter("doc > low").select("doc", "hash", "span")
    ranges, _ = scratch.cut(
        met.filter("repeated").select("doc", "hash", "span").unionByName(again)
        .groupBy("doc", "hash").agg(F.collect_list("span").alias("spans")))
    return ranges


def text_hash(text: Column) -> Column:
    """Tells rows apart that share a key but not a text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW,
    anchor: int = ANCHOR,
) -> DataFrame:
    """All columns of ``docs`` with ``kept_text``, ``n_words`` and ``n_removed`` added.

    A window is ``window`` consecutive words of one document. Every word covered by a window
    whose words also start in a document with a smaller key goes; windows are judged on the
    input. ``kept_text`` is the rest, joined by one space.

    Null and empty texts have no words and an empty ``kept_text``; texts shorter than a
    window lose nothing. A document never repeats itself, and rows with a null key neither
    lose words nor take any. Rows that repeat a key count as one document with each of their
    texts. An empty table gives an empty one. Columns of ``docs`` named like an added one
    are replaced.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    own = docs.drop("kept_text", "n_words", "n_removed")
    names = own.columns
    spans = "spans"
    while spans in map(str.lower, names):
        spans += "_"
    marked = own.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(key).alias("doc"),
        text_hash(F.col(text)).alias("hash"))
    ranges = repeats(
        docs.select(F.col(key).alias("doc"), text_hash(F.col(text)).alias("hash"),
                    F.col(text).alias("text")), scratch, window, anchor)
    joined = marked.join(
        ranges.withColumnRenamed("spans", spans), ["doc", "hash"], "left").select("row.*", spans)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, text):
            kept, n_words, n_removed = [], [], []
            for value, ranges in zip(texts, part.column(spans), strict=True):
                words = words_of(value)
                n_words.append(len(words))
                if ranges.is_valid:
                    ranges = np.asarray(ranges.values, np.int64)
                    inside = np.zeros(len(words) + 1, np.int64)
                    np.add.at(inside, ranges >> 32, 1)
                    np.add.at(inside, ranges & 0xFFFFFFFF, -1)
                    stay = np.flatnonzero(np.cumsum(inside[:-1]) == 0)
                    n_removed.append(len(words) - len(stay))
                    words = [words[i] for i in stay.tolist()]
                else:
                    n_removed.append(0)
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in names], pa.array(kept, pa.string()),
                 pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())],
                [*names, "kept_text", "n_words", "n_removed"])

    shape = ", ".join(f"`{c}` {own.schema[c].dataType.simpleString()}" for c in names)
    return joined.mapInArrow(cut, f"{shape}, kept_text string, n_words bigint, n_removed bigint")
