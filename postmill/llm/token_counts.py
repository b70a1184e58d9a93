"""Tokens per section of whole documents, by character offsets."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_worker, text_slices

#: Who gets a token that lies in several sections: the one with most of its characters (the
#: earlier of equals), or the one with its first or last character.
RULES = ("majority", "first", "last")


class Offsets:
    """A byte-level encoder that also tells where in the text each token lies."""

    def __init__(self, held: dict):
        ranks = {base64.b64decode(token): int(rank)
                 for token, rank in map(bytes.split, held["file"].splitlines())}
        self.encoding = tiktoken.Encoding(
            "ranks", pat_str=held["pattern"], mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(1 + max(ranks.values()), np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First character of every token and the one after its last.

        Tokens are runs of bytes; one that holds a part of a character covers all of it.
        """
        sizes = self.sizes[self.encoding.encode_ordinary(text)]
        stop = np.cumsum(sizes)
        start = stop - sizes
        if text.isascii():
            return start, stop
        leads = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
        character = np.cumsum(leads) - 1
        return character[start], character[stop - 1] + 1


def attribute(
    start: np.ndarray, stop: np.ndarray, first: np.ndarray, last: np.ndarray, rule: str,
) -> np.ndarray:
    """Section of each token, -1 for none; sections ``first`` to ``last`` rise and are disjoint.

    A token's sections are consecutive, so both ends of the range are found by bisection.
    """
    low = np.searchsorted(last, start, "right")
    high = np.searchsorted(first, stop, "left") - 1
    if not len(first):
        return np.full(len(start), -1)
    if rule == "majority":
        owner = low.copy()
        for i in np.flatnonzero(low < high).tolist():
            own = np.arange(low[i], high[i] + 1)
            shared = np.minimum(last[own], stop[i]) - np.maximum(first[own], start[i])
            owner[i] = own[shared.argmax()]
    else:
        owner = low.copy() if rule == "first" else high.copy()
    owner[low > high] = -1
    return owner


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Every line with its line feed, as character ranges; the last may be empty."""
    sizes = np.array([len(line) + 1 for line in text.split("\n")], np.int64)
    sizes[-1] -= 1
    last = np.cumsum(sizes)
    return last - sizes, last


def section_tokens(
    docs: DataFrame, ranks: str, pattern: str, sections: str | None = None,
    rule: str = "majority", key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``key, section, start, length, n_tokens``: tokens of every section of every text.

    A document is encoded once as a whole, so the counts of its sections and of section
    null, which holds the tokens outside all sections and is left out if there are none, add
    up to its tokens. ``sections`` names an array of ``start, stop`` character ranges that
    rise and do not overlap; without it a section is a line with its line feed. ``rule`` says
    who gets a token that crosses a border.

    A null text counts as empty: one empty line, or the ranges of its array, with no tokens.
    A null or empty array leaves the null section only. Ranges beyond the text get nothing.
    Rows are independent: repeated rows and null keys stay. An empty table gives an empty
    one; other columns are not read. One narrow pass, no shuffle.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    with open(ranks, "rb") as f:
        state = docs.sparkSession.sparkContext.broadcast({"file": f.read(), "pattern": pattern})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets = per_worker(state, "offsets", Offsets)
        for part, texts in text_slices(batches, text):
            rows, number, start, length, tokens = [], [], [], [], []
            given = part.column(sections).to_pylist() if sections else [None] * len(texts)
            for i, value in enumerate(texts):
                value = value or ""
                if sections:
                    pairs = np.array([tuple(r.values()) for r in given[i] or []], np.int64)
                    first, last = pairs.reshape(-1, 2).T
                else:
                    first, last = line_sections(value)
                owner = attribute(*offsets.spans(value), first, last, rule)
                counts = np.bincount(owner + 1, minlength=len(first) + 1)
                own = np.arange(0 if counts[0] else 1, len(counts))
                rows.append(np.full(len(own), i))
                number.append(own - 1)
                start.append(np.append(-1, first)[own])
                length.append(np.append(0, last - first)[own])
                tokens.append(counts[own])
            number = np.concatenate(number) if number else np.zeros(0, np.int64)
            outside = number < 0
            joined = [np.concatenate(x) if x else np.zeros(0, np.int64)
                      for x in (rows, start, length, tokens)]
            yield pa.RecordBatch.from_arrays([
                part.column(key).take(pa.array(joined[0])),
                pa.array(number.astype(np.int32), mask=outside),
                pa.array(joined[1], mask=outside), pa.array(joined[2], mask=outside),
                pa.array(joined[3].astype(np.int64))],
                [key, "section", "start", "length", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    columns = [F.col(key), F.col(text)]
    if sections:
        columns.append(F.transform(
            sections, lambda r: F.struct(r["start"].alias("start"), r["stop"].alias("stop"))
        ).alias(sections))
    return docs.select(*columns).mapInArrow(
        run, f"`{key}` {kind}, section int, start bigint, length bigint, n_tokens bigint")
