"""Packing documents into sequences by best fit and a swap-based local search."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import word_bpe_file, worker_bpe
from .common import Scratch, text_slices

#: Pieces packed together in one group; a group wastes part of one sequence at most.
GROUP_PIECES = 16_384
#: Id set after every document.
END_ID = 0


def pieces_of(
    docs: DataFrame, tokenizer: str, size: int, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``key, piece, start, length, ids_crc32``: every document's ids, cut only beyond ``size``."""
    state = word_bpe_file(docs.sparkSession, tokenizer)
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(state, "library")
        for part, texts in text_slices(batches, text):
            rows, piece, start, length, crc = [], [], [], [], []
            for i, value in enumerate(texts):
                ids = bpe.encode_bytes(value) + end
                for n, at in enumerate(range(0, len(ids), 4 * size)):
                    cut = ids[at:at + 4 * size]
                    rows.append(i)
                    piece.append(n)
                    start.append(at // 4)
                    length.append(len(cut) // 4)
                    crc.append(zlib.crc32(cut))
            yield pa.RecordBatch.from_arrays(
                [part.column(key).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                 pa.array(crc, pa.int64())],
                [key, "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(
        run, f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Bins of item numbers: items by falling length, each into the fullest bin it fits.

    Bins stand by their free room; a bit mask of the rooms in use finds the smallest enough.
    """
    by_room: list[list[list[int]]] = [[] for _ in range(size + 1)]
    rooms = 0
    for item in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[item])
        fitting = rooms >> need
        if fitting:
            room = need + (fitting & -fitting).bit_length() - 1
            chosen = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, chosen = size, []
        chosen.append(item)
        by_room[room - need].append(chosen)
        rooms |= 1 << (room - need)
    return [b for at_room in by_room for b in at_room]


class _Underfull:
    """The bins with room left, and the exchanges that push fill from one to fuller ones.

    What a bin may give back, nothing (a move), one item or two, is listed by the tokens that
    stay behind: an offer of ``given`` tokens fits where at most ``size - given`` stay, and of
    the exchanges that leave as many the one that returns the fewest tokens is best. So
    ``least`` holds one number per count of tokens left, and the best exchange of an offer is a
    search over those, however many bins there are. Only the two bins of an exchange change
    their entries; old ones are skipped when they come to the head of their queue.
    """

    def __init__(self, bins: list[list[int]], lengths: np.ndarray, size: int):
        self.bins, self.lengths, self.size = bins, lengths.tolist(), size
        self.fill = [sum(self.lengths[i] for i in b) for b in bins]
        self.version = [0] * len(bins)
        self.left = np.arange(size + 1)
        # One row for what returns one item at most, one for any.
        self.queues = [[[] for _ in range(size + 1)] for _ in range(2)]
        self.least = np.full((2, size + 1), size + 1)
        for n in range(len(bins)):
            self._add(n)

    def _choices(self, items: list[int]) -> tuple[dict[int, tuple], dict[int, tuple]]:
        """One item, and two, by their tokens: one choice for each number of tokens."""
        by_length: dict[int, list[int]] = {}
        for i in items:
            same = by_length.setdefault(self.lengths[i], [])
            if len(same) < 2:
                same.append(i)
        one = {length: (same[0],) for length, same in by_length.items()}
        two: dict[int, tuple] = {}
        kinds = sorted(by_length.items())
        for x, (length, same) in enumerate(kinds):
            if len(same) == 2:
                two.setdefault(2 * length, tuple(same))
            for other, others in kinds[x + 1:]:
                two.setdefault(length + other, (same[0], others[0]))
        return one, two

    def _entries(self, n: int) -> list[tuple[int, int, tuple]]:
        """Row, tokens returned and items returned."""
        one, two = self._choices(self.bins[n])
        return [(0, 0, ()), *((0, back, taken) for back, taken in one.items()),
                *((1, back, taken) for back, taken in two.items())]

    def _refresh(self, row: int, left: int) -> None:
        queue = self.queues[row][left]
        while queue and self.version[queue[0][1]] != queue[0][2]:
            heappop(queue)
        own = queue[0][0] if queue else self.size + 1
        if row == 0:
            self.least[0, left] = own
            queue = self.queues[1][left]
            while queue and self.version[queue[0][1]] != queue[0][2]:
                heappop(queue)
            self.least[1, left] = min(own, queue[0][0] if queue else own)
        else:
            self.least[1, left] = min(own, self.least[0, left])

    def _add(self, n: int) -> None:
        if self.bins[n]:
            for row, back, taken in self._entries(n):
                left = self.fill[n] - back
                heappush(self.queues[row][left], (back, n, self.version[n], taken))
                self.least[row:, left] = np.minimum(self.least[row:, left], back)

    def _drop(self, n: int) -> None:
        self.version[n] += 1
        touched = {(row, self.fill[n] - back) for row, back, _ in self._entries(n)}
        for row, left in sorted(touched, reverse=True):
            self._refresh(row, left)

    def _best(self, low: int, given: int, most: int) -> tuple[int, int, tuple] | None:
        """The exchange for ``given`` tokens of bin ``low`` that lifts squared fill the most.

        At most ``most`` items come back. Bin, tokens returned and items returned; bin ``low``
        itself must have no entries.
        """
        end = self.size - given + 1
        least = self.least[most - 1, :end]
        gain = given - least
        # Squared fill grows by 2 * gain * (new fill - fill of low) for each exchange.
        lift = np.maximum(gain, 0) * (self.left[:end] + (given - self.fill[low]))
        left = int(lift.argmax())
        if lift[left] <= 0:
            return None
        heads = [self.queues[row][left][0] for row in range(most) if self.queues[row][left]
                 and self.queues[row][left][0][0] == least[left]
                 and self.version[self.queues[row][left][0][1]] == self.queues[row][left][0][2]]
        back, n, _, taken = heads[0]
        return n, back, taken

    def improve(self, low: int) -> bool:
        """Push fill out of bin ``low`` until nothing helps; tells whether anything did."""
        moved = False
        self._drop(low)
        while self.bins[low]:
            one, two = self._choices(self.bins[low])
            # One for one, two for one, one for two, or a move of either.
            offers = sorted(
                [(-g, 2, taken) for g, taken in one.items()]
                + [(-g, 1, taken) for g, taken in two.items()])
            for given, most, offer in offers:
                found = self._best(low, -given, most)
                if found:
                    break
            else:
                break
            other, back, returned = found
            self._drop(other)
            self.bins[low] = [i for i in self.bins[low] if i not in offer] + list(returned)
            self.bins[other] = [i for i in self.bins[other] if i not in returned] + list(offer)
            self.fill[low] += given + back
            self.fill[other] -= given + back
            if self.fill[other] < self.size:
                self._add(other)
            moved = True
        self._add(low)
        return moved


def pack(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Bins of item numbers, none above ``size``: best fit, then local search.

    The search takes the underfull bins from the emptiest up and exchanges one or two of a
    bin's items for none, one or two of a fuller bin's, three items in all at most, until no
    such exchange raises the sum of squared fills; a bin left empty is gone. Every step raises
    that sum, which is bounded, so it ends.
    """
    bins = best_fit(lengths, size)
    fill = [int(lengths[b].sum()) for b in bins]
    full = [b for b, f in zip(bins, fill, strict=True) if f == size]
    search = _Underfull([b for b, f in zip(bins, fill, strict=True) if f < size], lengths, size)
    moved = True
    while moved:
        moved = False
        for low in np.argsort(search.fill, kind="stable").tolist():
            if search.bins[low] and search.fill[low] < size:
                moved |= search.improve(low)
    return full + [b for b in search.bins if b]


def pack_documents(
    docs: DataFrame, tokenizer: str, size: int = 2048, key: str = "doc_id", text: str = "text",
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """``key, piece, start, length, ids_crc32, sequence_id, offset`` of every piece.

    A document is its ids and one end id; only documents longer than ``size`` are cut, into
    pieces of ``size`` and a rest. Full pieces are sequences of their own. The others are
    dealt by hash into groups of about ``group_pieces`` and packed there, so no task holds
    more than a group, whatever the corpus.

    Null and empty texts are one end id. Rows are packed one by one: repeated rows, ties and
    null keys each take their own place. An empty table gives an empty one; other columns
    are not read.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pieces, _ = scratch.cut(
        pieces_of(docs, tokenizer, size, key, text)
        .withColumn("row", F.monotonically_increasing_id()))
    full = pieces.filter(F.col("length") == size).select(
        *[c for c in pieces.columns if c != "row"], (-1 - F.col("row")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))
    short = pieces.filter(F.col("length") < size)
    groups = max(1, -(-short.count() // group_pieces))
    names = list(full.columns)
    columns = [c for c in names if c not in ("sequence_id", "offset")]

    def run(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        order = np.argsort(table.column("row").to_numpy(), kind="stable")
        sequence, offset = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        first = int(table.column("bucket")[0].as_py()) << 32
        for n, items in enumerate(pack(lengths[order], size)):
            own = order[items]
            sequence[own] = first + n
            offset[own] = np.cumsum(lengths[own]) - lengths[own]
        return pa.table(
            [*[table.column(c) for c in columns], pa.array(sequence), pa.array(offset)],
            names=names)

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in full.schema)
    packed = short.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(groups))).groupBy(
        "bucket").applyInArrow(run, shape)
    return full.unionByName(packed)
