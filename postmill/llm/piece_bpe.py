"""SentencePiece encoding and decoding for merge-type models, by backtracking."""

from __future__ import annotations

import codecs
import re
from array import array
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from .bpe import Recent
from .common import per_worker, text_slices

#: Stands for a blank in pieces.
BLANK = "▁"
#: Words per generation of a worker's cache, and remembered answers about pairs of pieces.
CACHED_WORDS = 500_000
CACHED_PAIRS = 1_000_000
#: What an id of no piece is written as.
UNKNOWN = " ⁇ "


class PieceBpe:
    """Encoder and decoder for a BPE model file of the ``sentencepiece`` library.

    The library merges, of all neighbouring symbols whose concatenation is a piece, those of
    the best score, the leftmost first, until none is left. That result is the only sequence
    of pieces in which every piece merges to itself and every two neighbours, merged again
    from their characters, come out as the same two. ``encode_word`` searches for it: longest
    pieces first, shorter ones where neighbours do not agree, and back where nothing fits.

    Only models without a character map, with a blank put before each text, other blanks
    kept, and bytes for unknown characters are taken; others raise ``ValueError``.
    """

    def __init__(self, raw: bytes):
        model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        count = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(count)]
        self.byte_of = {i: int(self.pieces[i][1:-1], 16) for i in range(count) if model.is_byte(i)}
        self.silent = {i for i in range(count) if model.is_control(i)}
        self.no_piece = model.unk_id()
        plain = [i for i in range(count)
                 if not (i in self.byte_of or i in self.silent or i == self.no_piece)]
        if len(self.byte_of) != 256 or any(map(model.is_unused, plain)) or (
                model.normalize("  a  B\n ") != f"{BLANK * 3}a{BLANK * 2}B\n{BLANK}"):
            raise ValueError("not a plain BPE model with byte pieces")
        self.byte_ids = [i for i, _ in sorted(self.byte_of.items(), key=lambda p: p[1])]
        self.score = {self.pieces[i]: model.get_score(i) for i in plain}
        self.id_of = {self.pieces[i]: i for i in plain}
        self.known = {p for p in self.id_of if len(p) == 1}
        if any(c not in self.known for p in self.id_of for c in p):
            raise ValueError("a piece holds a character that is no piece")
        self.size = [len(p) for p in self.pieces]
        # Pieces that come out of merging their own characters; the rest never occur.
        whole = {p for p in self.id_of if self.merged(p) == [p]}
        self.machine = ahocorasick.Automaton()
        for piece in whole:
            self.machine.add_word(piece, self.id_of[piece])
        self.machine.make_automaton()
        #: The longest piece that a piece begins with, other than itself; -1 for none.
        self.shorter = [-1] * count
        for piece in whole:
            self.shorter[self.id_of[piece]] = next(
                (self.id_of[piece[:n]] for n in range(len(piece) - 1, 0, -1) if piece[:n] in whole), -1)
        # Where no piece goes on into a blank, texts fall into words of their own.
        inner = any(BLANK in p.lstrip(BLANK) for p in whole)
        self.word = re.compile(f"{BLANK}({BLANK}*[^{BLANK}]+|{BLANK}*)")
        self.strange = re.compile("([^" + "".join(map(re.escape, sorted(self.known))) + "])")
        self.whole_texts = inner
        self.raw = [
            bytes([self.byte_of[i]]) if i in self.byte_of else b"" if i in self.silent
            else UNKNOWN.encode() if i == self.no_piece else p.replace(BLANK, " ").encode()
            for i, p in enumerate(self.pieces)]
        self.pairs: dict[int, bool] = {}
        self.parts = Recent(lambda part: array("I", self.search(part)).tobytes(), CACHED_WORDS)
        self.words = Recent(lambda word: self.encode_word(BLANK + word), CACHED_WORDS)
        codecs.register_error("each_byte", lambda wrong: ("\ufffd", wrong.start + 1))

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging its characters, one pair at a time."""
        symbols, score = list(text), self.score
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                found = score.get(symbols[i] + symbols[i + 1])
                if found is not None and (best is None or found > best):
                    best, at = found, i
            if at < 0:
                break
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def agree(self, left: int, right: int) -> bool:
        """Whether two neighbouring pieces come out again when their characters are merged."""
        if len(self.pairs) >= CACHED_PAIRS:
            self.pairs.clear()
        first, second = self.pieces[left], self.pieces[right]
        same = self.merged(first + second) == [first, second]
        self.pairs[left << 32 | right] = same
        return same

    def search(self, word: str) -> list[int]:
        """Ids of a word of known characters.

        ``failed`` has a bit for every position that no sequence of pieces leads on from; it
        is laid out when the first one fails. As a position is reached by one sequence only,
        none is tried twice.
        """
        n, matches = len(word), self.machine.iter_long
        known, shorter, sizes, failed = self.pairs.get, self.shorter, self.size, None
        at, ids, ahead = 0, [], matches(word)
        piece = longest = next(ahead)[1]
        while at < n:
            while piece >= 0:
                end = at + sizes[piece]
                if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                    if not ids:
                        break
                    same = known(ids[-1] << 32 | piece)
                    if same or same is None and self.agree(ids[-1], piece):
                        break
                piece = shorter[piece]
            if piece >= 0:
                ids.append(piece)
                at = end
                if at < n:
                    if piece != longest:
                        ahead = matches(word, at)
                    piece = longest = next(ahead)[1]
            else:
                if failed is None:
                    failed = bytearray((n >> 3) + 1)
                failed[at >> 3] |= 1 << (at & 7)
                last = ids.pop()
                at -= sizes[last]
                piece, longest = shorter[last], -1
        return ids

    def encode_word(self, word: str) -> bytes:
        """Ids of a word; characters that are no pieces become the pieces of their bytes."""
        parts = self.strange.split(word)
        if len(parts) == 1:
            return array("I", self.search(word)).tobytes()
        out = []
        for n, part in enumerate(parts):
            if n % 2:
                out.append(array("I", [self.byte_ids[b] for b in part.encode()]).tobytes())
            elif part:
                out.append(self.parts[part])
        return b"".join(out)

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text; null is empty."""
        if not text:
            return np.zeros(0, "<u4")
        words = text.split(" ")
        if self.whole_texts:
            words = [text.replace(" ", BLANK)]
        elif "" in words or BLANK in text:
            words = self.word.findall(BLANK + text.replace(" ", BLANK))
        return np.frombuffer(b"".join(map(self.words.__getitem__, words)), "<u4")

    def decode(self, ids: Sequence[int]) -> str:
        """The text of any ids: pieces joined, byte pieces read as UTF-8.

        One blank goes from the beginning, unless a byte piece made it. Each byte that is no
        valid UTF-8 becomes U+FFFD, an id of no piece ``UNKNOWN``; marks such as begin and
        end have no text.
        """
        if not self.silent.isdisjoint(ids):
            return self._between_marks(ids)
        raw = b"".join(map(self.raw.__getitem__, ids))
        if len(ids) and self.pieces[ids[0]].startswith(BLANK):
            raw = raw[1:]
        return raw.decode(errors="each_byte")

    def _between_marks(self, ids: Sequence[int]) -> str:
        """As ``decode``; bytes before and after a mark are no common character."""
        runs: list[bytearray] = [bytearray()]
        fresh = True
        for i in ids:
            if i in self.silent:
                runs.append(bytearray())
            else:
                runs[-1] += self.raw[i][fresh and self.pieces[i].startswith(BLANK):]
                fresh = False
        return "".join([run.decode(errors="each_byte") for run in runs])


def piece_file(spark: SparkSession, path: str) -> Broadcast:
    """The model file for the tasks; its size is that of a vocabulary, not of the data."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast({"file": f.read()})


def encode_pieces(
    docs: DataFrame, model: str, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``key``, ``ids`` and ``decoded`` of every whole text.

    Ids equal the library's encoding without begin and end ids, the bytes of unknown
    characters included. ``decoded`` is made from the ids. Null and empty texts have no ids
    and an empty ``decoded``; rows are independent, so repeated rows and null keys stay as they
    are and an empty table gives an empty one. One narrow pass, no shuffle; each distinct word
    is searched once per worker while its cache holds it. Other columns are not read.
    """
    state = piece_file(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = per_worker(state, "pieces", lambda held: PieceBpe(held["file"]))
        for part, texts in text_slices(batches, text):
            ids = [bpe.encode(t) for t in texts]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([
                part.column(key),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                pa.array([bpe.decode(i.tolist()) for i in ids], pa.string()),
            ], [key, "ids", "decoded"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(
        run, f"`{key}` {kind}, ids array<int>, decoded string")
