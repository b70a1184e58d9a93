"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_ROWS, Scratch, text_slices

#: Labelled documents the field is fitted on (expected number).
SAMPLE_DOCS = 4000
#: Runs of lines that the driver gets the features of (expected number); 7 kB each.
SAMPLE_RUNS = 16_000
#: Lines per training sequence; longer documents give several.
SEQUENCE = 16
STEPS = 100
#: Weight of the squared norm.
RIDGE = 1e-3

#: Classes of bytes: lower, upper, digit, blank, full stop or comma, other sentence marks,
#: exclamation, bar, other ASCII marks, beyond ASCII.
CLASSES = np.full(256, 8, np.uint8)
for _number, _chars in enumerate((
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789",
    b" \t\r\x0b\x0c", b".,", b";:?'\"()-", b"!", b"|",
)):
    CLASSES[np.frombuffer(_chars, np.uint8)] = _number
CLASSES[128:] = 9
KINDS = 10
#: Bytes whose classes are counted at once.
BLOCK_BYTES = 1 << 20
#: Features of one line; a row of the field also holds those of both neighbours.
WIDTH = KINDS + 9


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line of ``texts``, bytes per line, and lines per text.

    Lines end at a line feed; null and empty texts are one empty line.
    """
    lines, per_text = [], []
    for text in texts:
        own = (text or "").encode().split(b"\n")
        lines += own
        per_text.append(len(own))
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    share = np.zeros((len(lines), KINDS))
    start, ends = 0, np.cumsum(sizes)
    while start < len(lines):
        # Some lines at a time, a long one by itself.
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] - sizes[start] + BLOCK_BYTES)))
        if sizes[start] > BLOCK_BYTES:
            kinds = lines[start].translate(CLASSES.tobytes())
            share[start] = [kinds.count(k) for k in range(KINDS)]
        else:
            kinds = CLASSES[np.frombuffer(b"".join(lines[start:stop]), np.uint8)]
            at = np.repeat(np.arange(stop - start) * KINDS, sizes[start:stop])
            share[start:stop] = np.bincount(
                at + kinds, minlength=(stop - start) * KINDS).reshape(-1, KINDS)
        start = stop
    share /= np.maximum(sizes, 1)[:, None]
    words, fresh, twice, marked = (np.zeros(len(lines)) for _ in range(4))
    for i, line in enumerate(lines):
        own = line.split()
        if own:
            words[i] = n = len(own)
            fresh[i] = len(set(own)) / n
            twice[i] = sum(map(eq, own, own[1:])) / n
            marked[i] = not own[-1][-1:].isalnum()
    heads = np.array([line[:1] for line in lines], "S1") if lines else np.zeros(0, "S1")
    rows = np.column_stack([
        share, np.log1p(sizes) / 5, np.log1p(words) / 4, sizes / np.maximum(words, 1) / 10,
        fresh, twice, marked, np.char.isupper(heads), sizes == 0, np.minimum(words, 3) / 3])
    return rows.astype(np.float64), sizes, np.array(per_text, np.int64)


def with_neighbours(rows: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Each line's features beside those of the lines before and after in its text, and 1."""
    ends = np.cumsum(per_text)
    before, after = np.zeros_like(rows), np.zeros_like(rows)
    if len(rows):
        before[1:], after[:-1] = rows[:-1], rows[1:]
        before[ends - per_text] = 0
        after[ends - 1] = 0
    return np.column_stack([rows, before, after, np.ones(len(rows))])


@dataclass
class QualityModel:
    """Weights of the good label, scores of label changes, and the scale of the outcome.

    ``change[a][b]``: score of label ``b`` after ``a``. The share of good text becomes a
    probability by ``slope * logit(share) + offset``.
    """

    weights: np.ndarray
    change: np.ndarray
    slope: float = 1.0
    offset: float = 0.0


def marginals(scores: list[float], change: list[list[float]]) -> list[float]:
    """Probability that each line is good, given all lines, by forward and backward sums."""
    n = len(scores)
    (c00, c01), (c10, c11) = [[math.exp(v) for v in row] for row in change]
    good = [1 / (1 + math.exp(-max(-500.0, min(500.0, s)))) for s in scores]
    forward = [good[0]]
    bad_now, good_now = 1 - good[0], good[0]
    for g in good[1:]:
        b, k = (bad_now * c00 + good_now * c10) * (1 - g), (bad_now * c01 + good_now * c11) * g
        total = b + k or 1.0
        bad_now, good_now = b / total, k / total
        forward.append(good_now)
    out = [0.0] * n
    bad_next = good_next = 1.0
    for i in range(n - 1, -1, -1):
        k, b = forward[i] * good_next, (1 - forward[i]) * bad_next
        out[i] = k / (k + b) if k + b else 0.5
        g = good[i]
        b, k = c00 * (1 - g) * bad_next + c01 * g * good_next, \
            c10 * (1 - g) * bad_next + c11 * g * good_next
        total = b + k or 1.0
        bad_next, good_next = b / total, k / total
    return out


def good_share(texts: list[str | None], model: QualityModel) -> np.ndarray:
    """Length-weighted mean of the line marginals of every text."""
    rows, sizes, per_text = line_features(texts)
    scores = (with_neighbours(rows, per_text) @ model.weights).tolist()
    change = model.change.tolist()
    out, at = [], 0
    for n in per_text.tolist():
        weight = sizes[at:at + n] + 1.0
        out.append(float(np.dot(marginals(scores[at:at + n], change), weight) / weight.sum()))
        at += n
    return np.array(out)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def sequences_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Runs of at most ``SEQUENCE`` lines: text number, run number, feature rows."""
    rows, _, per_text = line_features(texts)
    rows = with_neighbours(rows, per_text)
    owner, number, runs = [], [], []
    at = 0
    for n, lines in enumerate(per_text.tolist()):
        for m, start in enumerate(range(at, at + lines, SEQUENCE)):
            owner.append(n)
            number.append(m)
            runs.append(rows[start:min(start + SEQUENCE, at + lines)])
        at += lines
    return np.array(owner, np.int64), np.array(number, np.int64), runs


def _laid_out(runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Runs as equally long sequences: features, and whether a line is there."""
    x = np.zeros((len(runs), SEQUENCE, 3 * WIDTH + 1))
    there = np.zeros((len(runs), SEQUENCE), bool)
    for i, run in enumerate(runs):
        x[i, :len(run)], there[i, :len(run)] = run, True
    return x, there


def _gradient(model: QualityModel, x, there, label):
    """Gradient of the mean log likelihood by forward and backward sums over all sequences."""
    count, length, _ = x.shape
    emit = np.zeros((count, length, 2))
    emit[:, :, 1] = x @ model.weights
    forward, backward = np.zeros_like(emit), np.zeros_like(emit)
    forward[:, 0] = emit[:, 0]
    for t in range(1, length):
        before = forward[:, t - 1]
        step = np.logaddexp(
            before[:, :1] + model.change[0], before[:, 1:] + model.change[1]) + emit[:, t]
        forward[:, t] = np.where(there[:, t, None], step, before)
    for t in range(length - 2, -1, -1):
        after = emit[:, t + 1] + backward[:, t + 1]
        step = np.logaddexp(
            after[:, :1] + model.change[:, 0], after[:, 1:] + model.change[:, 1])
        backward[:, t] = np.where(there[:, t + 1, None], step, 0)
    total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
    good = np.exp(forward[:, :, 1] + backward[:, :, 1] - total[:, None])
    miss = np.where(there, label[:, None] - good, 0)
    by_weight = np.tensordot(miss, x, axes=([0, 1], [0, 1]))
    pair = np.exp(
        forward[:, :-1, :, None] + model.change + (emit + backward)[:, 1:, None, :]
        - total[:, None, None, None])
    pair = np.where(there[:, 1:, None, None], pair, 0).sum(axis=(0, 1))
    seen = np.zeros((2, 2))
    for value in (0, 1):
        seen[value, value] = there[:, 1:][label == value].sum()
    lines = max(1, there.sum())
    return by_weight / lines - RIDGE * model.weights, (seen - pair) / lines - RIDGE * model.change


def _constant(labels: np.ndarray) -> QualityModel | None:
    """The model of labels that are all alike, or of none."""
    if len(labels) and labels.min() != labels.max():
        return None
    offset = 0.0 if not len(labels) else (4.0 if labels[0] else -4.0)
    return QualityModel(np.zeros(3 * WIDTH + 1), np.zeros((2, 2)), 1.0, offset)


def fit_field(runs: list[np.ndarray], label: np.ndarray, steps: int = STEPS) -> QualityModel:
    """Weights and scores of changes, from runs of lines that all take their document's label."""
    x, there = _laid_out(runs)
    model = QualityModel(np.zeros(x.shape[2]), np.zeros((2, 2)))
    first, second = [0.0, 0.0], [0.0, 0.0]
    for step in range(1, steps + 1):
        for i, slope in enumerate(_gradient(model, x, there, label)):
            first[i] = 0.9 * first[i] + 0.1 * slope
            second[i] = 0.99 * second[i] + 0.01 * slope ** 2
            move = 0.1 * (first[i] / (1 - 0.9 ** step)) / (
                np.sqrt(second[i] / (1 - 0.99 ** step)) + 1e-8)
            if i == 0:
                model.weights = model.weights + move
            else:
                model.change = model.change + move
    return model


def scale_to(model: QualityModel, shares: np.ndarray, labels: np.ndarray) -> QualityModel:
    """Set how a document's share of good text becomes a probability."""
    share = _logit(shares)
    slope, offset = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(slope * share + offset)))
        weight, miss = p * (1 - p) + 1e-9, labels - p
        hessian = np.array([[(weight * share ** 2).sum() + 1.0, (weight * share).sum()],
                            [(weight * share).sum(), weight.sum() + 1.0]])
        change = np.linalg.solve(hessian, [
            (miss * share).sum() - (slope - 1.0), miss.sum() - offset])
        slope, offset = slope + change[0], offset + change[1]
    model.slope, model.offset = max(0.05, float(slope)), float(offset)
    return model


def train(texts: list[str | None], labels: np.ndarray, steps: int = STEPS) -> QualityModel:
    """Fit the field on texts at hand; ``fit`` does the same for a table."""
    constant = _constant(labels)
    if constant:
        return constant
    owner, _, runs = sequences_of(texts)
    model = fit_field(runs, labels[owner].astype(np.int64), steps)
    return scale_to(model, good_share(texts, model), labels)


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id",
    text: str = "text", sample_docs: int = SAMPLE_DOCS, sample_runs: int = SAMPLE_RUNS,
) -> QualityModel:
    """Fit on about ``sample_docs`` labelled documents, taken by the hash of their key.

    ``labels`` holds ``key`` and a 0/1 ``label``; rows with a null in either teach nothing,
    and of several labels for a key the largest counts. Features are made where the texts
    are: the driver gets features of about ``sample_runs`` runs of ``SEQUENCE`` lines, taken
    by hash if the sample has more, and one share per document, of about twice ``sample_docs``
    where keys repeat. No text reaches it, and nothing that grows with the corpus or with the
    length of a text. Without labels of both kinds the model answers alike for every text.
    """
    named = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(
        (F.max(label) > 0).cast("int").alias("good"))
    number = named.count()
    drawn = named.filter(_drawn(sample_docs / max(1, number), F.lit("sample"), F.col(key)))
    scratch = Scratch(docs.sparkSession, "quality")
    sample, path = scratch.cut(
        docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
        .join(F.broadcast(drawn.withColumnRenamed(key, "key")), "key"))
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1))
    facts = sample.agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.ceil(lines / SEQUENCE)).alias("runs")).first()
    rows = sample.filter(_drawn(2 * sample_docs / max(1, facts.rows), "key", "text")).select(
        F.xxhash64("key", "text").alias("row"), "text", "good")

    def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "text"):
            owner, run, features = sequences_of(texts)
            for at in range(0, len(owner), SLICE_ROWS):
                some = slice(at, at + SLICE_ROWS)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row").take(pa.array(owner[some])), pa.array(run[some]),
                     part.column("good").take(pa.array(owner[some])),
                     pa.array([f.tobytes() for f in features[some]], pa.binary())],
                    ["row", "run", "good", "features"])

    found = rows.mapInArrow(runs_of, "row bigint, run bigint, good int, features binary").filter(
        _drawn(sample_runs / max(1, facts.runs or 0), "row", "run")).toArrow().sort_by(
        [("row", "ascending"), ("run", "ascending")])
    good = found["good"].to_numpy().astype(np.int64)
    model = _constant(good)
    if model is None:
        runs = [np.frombuffer(f, np.float64).reshape(-1, 3 * WIDTH + 1)
                for f in found["features"].to_pylist()]
        model = field = fit_field(runs, good)

        def shares_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, texts in text_slices(batches, "text"):
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("good"), pa.array(good_share(texts, field))],
                    ["row", "good", "share"])

        shares = rows.mapInArrow(shares_of, "row bigint, good int, share double").toArrow().sort_by(
            [("row", "ascending")])
        model = scale_to(field, shares["share"].to_numpy(), shares["good"].to_numpy().astype(np.int64))
    scratch.drop(path)
    return model


def _drawn(share: float, *values: Column | str) -> Column:
    """About ``share`` of the rows, by the hash of ``values``; all from 1 on."""
    if share >= 1:
        return F.lit(True)
    return F.pmod(F.xxhash64(*values), F.lit(1 << 20)) < F.lit(share * (1 << 20))


def score(
    docs: DataFrame, model: QualityModel, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``key, score``: how likely every whole text is good, 0 to 1.

    A line's probability uses its neighbours' features and, through the chain, all lines of
    its document; the document's share of good text is their mean by length and is then
    scaled to a probability. Null and empty texts are one empty line. Rows are independent:
    repeated rows and null keys stay. An empty table gives an empty one; other columns are
    not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, text):
            odds = model.slope * _logit(good_share(texts, model)) + model.offset
            yield pa.RecordBatch.from_arrays(
                [part.column(key), pa.array(1 / (1 + np.exp(-odds)))], [key, "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, score double")
