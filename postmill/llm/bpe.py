"""BPE encoding and decoding with a priority queue over linked symbols."""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from .common import per_worker, text_slices

#: Words longer than this are encoded each time; they hardly ever come again.
CACHED_LENGTH = 48
#: Entries per generation of a worker's word cache (two generations are held).
CACHED_WORDS = 500_000
#: From this character on the file's own normaliser and splitter are asked.
FIRST_UNSURE = "\u0250"
#: Separators that Python counts as white space and the tokenizer does not.
NOT_SPACE = regex.compile(r"[\x1c-\x1f]")
SPACE = regex.compile(r"[^\S\x1c-\x1f]+")


def _byte_symbols() -> list[str]:
    """The printable stand-in for every byte, as byte-level vocabularies write them."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(shifted)) for b in range(256)]


class Recent(dict):
    """A bounded memo of ``make``: two generations, the older one dropped as the newer fills."""

    def __init__(self, make, limit: int = CACHED_WORDS):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= CACHED_LENGTH:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class WordBpe:
    """Encoder and decoder for a lower-casing BPE file with word ends.

    Reads a ``tokenizers`` JSON file of that kind: NFC, white space folded, lower case,
    words split off by the file's pattern, merges over byte symbols with a word-end suffix.
    White space never joins a word, so a text is encoded by its blank-separated pieces and
    each distinct piece only once per worker. ``engine`` says who encodes a new word:
    ``queue`` is the merge queue below, ``library`` the file's own model from the
    ``tokenizers`` library; both give the same ids.
    """

    def __init__(self, raw: bytes, engine: str = "queue"):
        spec = json.loads(raw)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"]:
            raise ValueError("not a lower-casing word BPE file")
        vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in (*vocab.items(), *self.special.items()):
            self.tokens[i] = token
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b])
                       for rank, (a, b) in enumerate(pairs)}
        self.products = [vocab[a + b] for a, b in pairs]
        self.symbols = _byte_symbols()
        self.byte_of = {symbol: b for b, symbol in enumerate(self.symbols)}
        self.inner = [vocab[s] for s in self.symbols]
        self.last = [vocab[s + suffix] for s in self.symbols]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.library = Tokenizer.from_str(raw.decode())
        self.model = self.library.model
        self._new_word = self._library_word if engine == "library" else self._queue_word
        self.words = Recent(self._new_word)
        self.pieces = Recent(self._piece)

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one word: merge the best-ranked pair until none is left.

        Symbols form a doubly linked list; the queue holds ``rank, position``. An entry is
        stale when the pair now at its position no longer has that rank.
        """
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_of, products = self.merges.get, self.products
        queue = []
        for i in range(n - 1):
            found = rank_of((ids[i], ids[i + 1]))
            if found:
                queue.append(found[0] << 32 | i)
        heapify(queue)
        while queue:
            entry = heappop(queue)
            i, rank = entry & 0xFFFFFFFF, entry >> 32
            right = after[i]
            if ids[i] < 0 or right >= n:
                continue
            found = rank_of((ids[i], ids[right]))
            if not found or found[0] != rank:
                continue
            ids[i], ids[right] = products[rank], -1
            after[i] = following = after[right]
            if following < n:
                before[following] = i
                found = rank_of((ids[i], ids[following]))
                if found:
                    heappush(queue, found[0] << 32 | i)
            left = before[i]
            if left >= 0:
                found = rank_of((ids[left], ids[i]))
                if found:
                    heappush(queue, found[0] << 32 | left)
        return [i for i in ids if i >= 0]

    def _queue_word(self, word: str) -> bytes:
        return array("I", self.merge(word.encode())).tobytes()

    def _library_word(self, word: str) -> bytes:
        if not (word.isascii() and word.isprintable()):
            word = "".join([self.symbols[b] for b in word.encode()])
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _split(self, text: str) -> list[str]:
        """Normalised words. Beyond the Latin blocks, where Unicode versions differ between
        libraries, the file's own normaliser and splitter decide."""
        if max(text) < FIRST_UNSURE:
            return self.pattern.findall(unicodedata.normalize("NFC", text).lower())
        plain = self.library.normalizer.normalize_str(text)
        return [bytes(map(self.byte_of.__getitem__, written)).decode()
                for written, _ in self.library.pre_tokenizer.pre_tokenize_str(plain)]

    def _piece(self, piece: str) -> bytes:
        if not piece:
            return b""
        if max(piece) < FIRST_UNSURE:
            # Most pieces are one word, or one word and a sentence mark.
            plain = piece.lower()
            if plain.isalpha():
                return self.words[plain]
            if plain[-1] in ".," and plain[:-1].isalpha():
                return self.words[plain[:-1]] + self.words[plain[-1]]
        out = []
        for part in self.marks.split(piece) if "<|" in piece else (piece,):
            if part in self.special:
                out.append(array("I", [self.special[part]]).tobytes())
            elif part:
                out += map(self.words.__getitem__, self._split(part))
        return b"".join(out)

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids of a whole text as unsigned 32-bit numbers; null is empty."""
        if not text:
            return b""
        pieces = SPACE.split(text) if NOT_SPACE.search(text) else text.split()
        return b"".join(map(self.pieces.__getitem__, pieces))

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), "<u4")

    def decode(self, ids) -> str:
        """The vocabulary strings of ``ids``, joined by one space: the file has no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))


def word_bpe_file(spark: SparkSession, path: str) -> Broadcast:
    """The tokenizer file for the tasks; its size is that of a vocabulary, not of the data."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast({"file": f.read()})


def worker_bpe(state: Broadcast, engine: str = "queue") -> WordBpe:
    return per_worker(state, engine, lambda held: WordBpe(held["file"], engine))


def encode_texts(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``key``, ``ids`` and ``decoded`` of every whole text.

    Ids equal the library's encoding without special tokens added; special strings inside a
    text become their own ids. ``decoded`` is made from the ids. Null and blank texts have no
    ids and an empty ``decoded``; rows are independent, so repeated rows and null keys stay as
    they are and an empty table gives an empty one. One narrow pass, no shuffle; other columns
    are not read.
    """
    state = word_bpe_file(docs.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(state)
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
