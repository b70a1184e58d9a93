"""Language identification with unigram pieces, summed over all segmentations."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Recent
from .common import Scratch, per_worker, text_slices

#: Labelled documents per language that the probabilities are estimated on (expected number).
SAMPLE_DOCS = 2000
#: Rounds of expectation and maximisation.
ROUNDS = 2
#: Expected count that every piece starts with in every language.
PSEUDO = 0.05
#: Answer for a text without letters.
UNKNOWN = "und"
WORDS = re.compile(r"[^\W\d_]+")
START = "▁"
#: Words per generation of a worker's cache of scores.
CACHED = 300_000
#: Where running products are scaled up again.
SMALL = 1e-120


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters (some number signs too; they have no pieces)."""
    return WORDS.findall(text.lower()) if text else []


def letter_pieces(path: str) -> list[str]:
    """The vocabulary's pieces of lower-case letters, with or without the word start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return sorted({p for p in found
                   if p.removeprefix(START).isalpha() and p == p.lower()} | {START})


class Lattice:
    """All pieces inside a word, by one pass of an automaton."""

    def __init__(self, pieces: list[str]):
        self.machine = ahocorasick.Automaton()
        for i, piece in enumerate(pieces):
            self.machine.add_word(piece, (len(piece), i))
        self.machine.make_automaton()
        self.known = {p for p in pieces if len(p) == 1}
        self.unknown = len(pieces)

    def edges(self, word: str) -> list[tuple[int, int, int]]:
        """``start, end, piece`` by rising end; a character that is no piece is the unknown one."""
        text = START + word
        found = [(end + 1 - size, end + 1, i) for end, (size, i) in self.machine.iter(text)]
        lone = [(n, n + 1, self.unknown) for n, c in enumerate(text) if c not in self.known]
        return sorted(found + lone, key=lambda e: e[1]) if lone else found

    def forward(self, edges, n: int, chance: list[float]) -> tuple[list[float], float]:
        """Probability of every prefix over all segmentations, and the log scale taken out.

        Prefix values are scaled up together when they get small, so words of any length
        have a finite logarithm.
        """
        at, scale, reach = [0.0] * (n + 1), 0.0, 1
        at[0] = 1.0
        for start, end, piece in edges:
            if end > reach and at[reach] < SMALL:
                top = max(at[max(0, reach - 32):reach + 1]) or 1.0
                for i in range(max(0, reach - 32), reach + 1):
                    at[i] /= top
                scale += math.log(top)
            reach = max(reach, end)
            at[end] += at[start] * chance[piece]
        return at, scale


@dataclass
class LanguageModel:
    """``chance[l][p]``: probability of piece ``p`` (the last one: an unknown character)."""

    languages: list[str]
    pieces: list[str]
    chance: np.ndarray


def _lattice(held: dict) -> Lattice:
    return Lattice(held["pieces"])


def fit(
    docs: DataFrame, vocabulary: str, text: str = "text", language: str = "lang",
    sample_docs: int = SAMPLE_DOCS, rounds: int = ROUNDS, key: str = "doc_id",
) -> LanguageModel:
    """Piece probabilities per language, by expectation and maximisation over whole texts.

    About ``sample_docs`` documents of each language are taken by the hash of their key; the
    counts of their words stay on the executors, and each round brings back one number per
    language and piece. Rows without a language or text teach nothing; languages whose drawn
    texts have no letters are not learned. Languages are taken to be few: one row each comes
    to the driver.
    """
    spark = docs.sparkSession
    labelled = docs.filter(F.col(language).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(language).count().collect()}
    pieces = letter_pieces(vocabulary)
    if not counts:
        return LanguageModel([], pieces, np.zeros((0, len(pieces) + 1)))
    rate = F.element_at(
        F.map_from_arrays(F.array(*[F.lit(k) for k in counts]),
                          F.array(*[F.lit(sample_docs / n) for n in counts.values()])),
        F.col(language))
    drawn = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 20)) < rate * (1 << 20)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, text):
            seen: Counter = Counter()
            for name, value in zip(part.column(language).to_pylist(), texts, strict=True):
                seen.update((name, w) for w in words_of(value))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in seen], pa.string()),
                 pa.array([k[1] for k in seen], pa.string()),
                 pa.array(list(seen.values()), pa.int64())], ["language", "word", "n"])

    scratch = Scratch(spark, "language")
    words, path = scratch.cut(
        labelled.filter(drawn).select(text, language)
        .mapInArrow(count, "language string, word string, n bigint")
        .groupBy("language", "word").agg(F.sum("n").alias("n")))
    languages = sorted(counts)
    size = len(pieces) + 1
    chance = np.full((len(languages), size), 1 / size)
    seen = np.zeros(len(languages))
    for _ in range(rounds):
        state = spark.sparkContext.broadcast(
            {"pieces": pieces, "chance": [row.tolist() for row in chance],
             "number": {k: i for i, k in enumerate(languages)}})

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = state.value
            lattice = per_worker(state, "lattice", _lattice)
            total = np.zeros((len(held["number"]), len(held["pieces"]) + 1))
            for batch in batches:
                for name, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    row = held["number"][name]
                    add_expected(lattice, word, n, held["chance"][row], total[row])
            rows, cols = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int32()), pa.array(cols, pa.int32()),
                 pa.array(total[rows, cols])], ["row", "piece", "n"])

        sums = (
            words.mapInArrow(expect, "row int, piece int, n double")
            .groupBy("row", "piece").agg(F.sum("n").alias("n")).toArrow())
        total = np.zeros_like(chance)
        total[sums["row"].to_numpy(), sums["piece"].to_numpy()] = sums["n"].to_numpy()
        seen = total.sum(axis=1)
        chance = (total + PSEUDO) / (seen[:, None] + PSEUDO * size)
        # An unknown character says nothing about the language.
        chance[:, -1] = 1e-9
    scratch.drop(path)
    learned = np.flatnonzero(seen > 0)
    return LanguageModel([languages[i] for i in learned], pieces, chance[learned])


def add_expected(lattice: Lattice, word: str, n: int, chance: list[float], out: np.ndarray) -> None:
    """Add ``n`` times the expected uses of each piece in ``word``, of any length.

    Words whose probability is not a number of ordinary size are counted by logarithms.
    """
    size = len(word) + 1
    edges = lattice.edges(word)
    at, scale = lattice.forward(edges, size, chance)
    if scale or at[size] < SMALL:
        add_expected_logs(edges, size, n, chance, out)
        return
    to_end = [0.0] * (size + 1)
    to_end[size] = 1.0
    for start, end, piece in sorted(edges, key=lambda e: -e[0]):
        to_end[start] += chance[piece] * to_end[end]
    for start, end, piece in edges:
        out[piece] += n * at[start] * chance[piece] * to_end[end] / at[size]


def add_logs(a: float, b: float) -> float:
    """Logarithm of the sum of two numbers given by theirs."""
    low, high = (a, b) if a < b else (b, a)
    return high if low == -math.inf else high + math.log1p(math.exp(low - high))


def add_expected_logs(
    edges: list[tuple[int, int, int]], size: int, n: int, chance: list[float], out: np.ndarray,
) -> None:
    """``add_expected`` with all sums kept as logarithms, which no length makes too small."""
    edges = [(start, end, piece, math.log(chance[piece]))
             for start, end, piece in edges if chance[piece] > 0]
    at, to_end = [-math.inf] * (size + 1), [-math.inf] * (size + 1)
    at[0] = to_end[size] = 0.0
    for start, end, _, log in edges:
        at[end] = add_logs(at[end], at[start] + log)
    if at[size] == -math.inf:
        return
    for start, end, _, log in sorted(edges, key=lambda e: -e[0]):
        to_end[start] = add_logs(to_end[start], log + to_end[end])
    for start, end, piece, log in edges:
        out[piece] += n * math.exp(at[start] + log + to_end[end] - at[size])


class Scorer:
    """Log probabilities of words in every language, kept per worker."""

    def __init__(self, held: dict):
        self.lattice = Lattice(held["pieces"])
        self.chance = held["chance"]
        self.words = Recent(self._word, CACHED)

    def _word(self, word: str) -> bytes:
        if not any(map(str.isalpha, word)):
            return b""
        edges, n = self.lattice.edges(word), len(word) + 1
        logs = []
        for chance in self.chance:
            at, scale = self.lattice.forward(edges, n, chance)
            logs.append(math.log(max(at[n], 1e-300)) + scale)
        return np.array(logs).tobytes()

    def logs(self, text: str | None) -> np.ndarray | None:
        """Log probability of a whole text in every language; None without letters."""
        raw = b"".join(map(self.words.__getitem__, words_of(text)))
        return np.frombuffer(raw).reshape(-1, len(self.chance)).sum(axis=0) if raw else None


def predict(
    docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text",
    keep: Sequence[str] = (),
) -> DataFrame:
    """``key``, the columns ``keep``, ``lang_pred, score`` of every whole text.

    ``score`` is the posterior of the answer.

    A text is its words, a word the sum over all its segmentations into pieces, languages
    are equally likely beforehand. Ties go to the first language by name. Null, empty and
    letterless texts, and every text if no language was learned, are ``und`` with score 0.
    Rows are independent: repeated rows and null keys stay. An empty table gives an empty
    one; columns beyond ``keep`` are not read.
    """
    kept = [c for c in dict.fromkeys([key, *keep]) if c not in ("lang_pred", "score")]
    languages = list(model.languages)
    state = docs.sparkSession.sparkContext.broadcast(
        {"pieces": model.pieces, "chance": [row.tolist() for row in model.chance]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = per_worker(state, "scorer", Scorer)
        for part, texts in text_slices(batches, text):
            names, scores = [], []
            for value in texts:
                logs = scorer.logs(value) if languages else None
                if logs is None:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                else:
                    best = int(logs.argmax())
                    names.append(languages[best])
                    scores.append(float(1 / np.exp(logs - logs[best]).sum()))
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in kept], pa.array(names, pa.string()),
                 pa.array(scores, pa.float64())], [*kept, "lang_pred", "score"])

    shape = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.select(*dict.fromkeys([*kept, text])).mapInArrow(
        run, f"{shape}, lang_pred string, score double")
