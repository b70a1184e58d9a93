"""Merge-type pieces, fill-in-the-middle texts and vector codes."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from cases import ODD_TEXTS, SF
from postmill.llm.bindings import QUERIES, tokenizer
from postmill.llm.fill_middle import BOUND, MARKS, RankIndex, fill_in_middle, restored
from postmill.llm.piece_bpe import PieceBpe, encode_pieces
from postmill.llm.vector_codes import (
    encode_vectors, exact_products, limbs, nearest, parts_of, train_codebooks, with_total,
)
from pyspark.sql import functions as F

MODEL = tokenizer("piece_bpe_32k.model")
PARTS = [*"aabcdeehino  \n\t▁日本語☃é\0'.,<>0x41s\U0001f389", "the", "ing", "  ", "     ",
         "<s>", "<0x41>", "</s>", "<unk>", "▁▁"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- merge-type pieces -------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def own():
    with open(MODEL, "rb") as f:
        return PieceBpe(f.read())


def test_random_texts_like_the_library(library, own):
    draw = random.Random(4)
    for _ in range(15_000):
        text = "".join(draw.choice(PARTS) for _ in range(draw.randrange(20)))
        ids = library.encode(text)
        assert own.encode(text).tolist() == ids, text
        assert own.decode(ids) == library.decode(ids), text


def test_joined_pieces_need_going_back(library, own):
    draw = random.Random(6)
    pieces = sorted(own.id_of)
    greedy = 0
    for _ in range(15_000):
        word = "".join(draw.choice(pieces) for _ in range(draw.randrange(1, 6))).replace("▁", "")
        ids = library.encode(word)
        assert own.encode(word).tolist() == ids, word
        greedy += [i for _, i in own.machine.iter_long("▁" + word)] == ids
    assert 0 < greedy < 15_000


def test_any_ids_decode_like_the_library(library, own):
    draw = random.Random(7)
    some = [0, 1, 2, 28705, *range(190, 259)]
    for _ in range(15_000):
        ids = [draw.choice([draw.choice(some), draw.randrange(32_000)])
               for _ in range(draw.randrange(9))]
        assert own.decode(ids) == library.decode(ids), ids


def test_long_words(library, own):
    for text in ("x" * 60_000, " " * 5000, "日" * 20_000, "abcdefghij" * 4000, "\U0001f389" * 3000):
        assert own.encode(text).tolist() == library.encode(text)
        assert own.decode(library.encode(text)) == text


def test_other_models_are_refused(monkeypatch):
    with open(MODEL, "rb") as f:
        raw = f.read()
    # The last spec of the file says that a blank is put before each text; say no.
    at = raw.rindex(b"identity")
    with pytest.raises(ValueError):
        PieceBpe(raw[:at] + raw[at:].replace(b"\x18\x01", b"\x18\x00"))


def test_pieces_of_odd_texts(frame, library):
    rows = encode_pieces(frame(ODD_TEXTS), MODEL).collect()
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in rows) == sorted(
        (str(i), library.encode(t or ""), library.decode(library.encode(t or "")))
        for i, t in ODD_TEXTS)
    assert encode_pieces(frame([]), MODEL).count() == 0


def test_op11_whole_table(spark, documents, library):
    got = {r.doc_id: r for r in QUERIES["op11_sentencepiece_codec"](spark, SF).collect()}
    for row in documents.collect():
        ids = library.encode(row.text or "")
        r = got.pop(row.doc_id)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
    assert not got


# --- fill in the middle ------------------------------------------------------------

def cut(key, text):
    """n, form, prefix and middle lengths and output, from the tokens themselves."""
    text = text or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n, digits = len(tokens), sha(f"42:{'' if key is None else key}")
    h = [int(digits[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(t) for t in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(m in text for m in MARKS) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    sizes = len(prefix), len(middle)
    if h[3] % 100 < 80:
        return n, "spm", *sizes, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", *sizes, f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_rank_index_is_exact_and_bounded():
    draw = np.random.default_rng(2)
    cases = [[], [0], [0, 0], [5, 9], np.cumsum(draw.integers(1, 12, 5000)),
             np.cumsum(draw.integers(0, 3000, 3000)), np.cumsum(draw.pareto(0.4, 4000).clip(0, 1e9)),
             np.concatenate([np.arange(2000), 10_000_000 + 7 * np.arange(2000)])]
    for offsets in cases:
        offsets = np.asarray(offsets, np.int64)
        index = RankIndex.fit(offsets)
        assert index.at(np.arange(len(offsets))).tolist() == offsets.tolist()
        assert np.abs(index.off.astype(int)).max(initial=0) <= BOUND
        if len(offsets):
            assert (index.first[0], index.off.dtype) == (0, np.int8)
    steady = RankIndex.fit(np.cumsum(draw.integers(4, 8, 100_000)))
    assert len(steady.first) < 200


def test_fill_in_middle_of_odd_texts(frame):
    draw = random.Random(8)
    parts = [*"ab <\t\n\x0b\x1cé日\U0001f389PSM>\xa0", *MARKS, "  ", "word "]
    texts = [*ODD_TEXTS, *((100 + i, "".join(draw.choice(parts) for _ in range(draw.randrange(25))))
                           for i in range(800))]
    rows = fill_in_middle(frame(texts)).withColumn(
        "back", restored(F.col("output"), F.col("form"))).collect()
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    assert Counter(tuple(r) for r in rows) == Counter((i, *cut(i, t), t or "") for i, t in texts)
    assert fill_in_middle(frame([])).count() == 0


def test_op12_whole_table(spark, documents):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_fill_in_middle"](spark, SF).collect()}
    for row in documents.collect():
        *front, output = cut(row.doc_id, row.text)
        assert got.pop(row.doc_id) == (*front, sha(output), sha(row.text or ""))
    assert not got


# --- vector codes ------------------------------------------------------------------

def test_products_are_exact_with_any_limbs():
    draw = np.random.default_rng(3)
    for size in (1, 2 ** 12, 2 ** 27, 2 ** 29):
        a, b = (draw.integers(-size, size, (n, 16)) for n in (40, 9))
        want = (a.astype(object) @ b.astype(object).T).tolist()
        for bits in (None, 3, 7, 24):
            assert exact_products(a, b, bits).tolist() == want
        for bits in (3, 24):
            assert sum(x.astype(object) * 2 ** (bits * i)
                       for i, x in enumerate(limbs(a, bits))).tolist() == a.tolist()
    # Past 53 bits one float product would be off.
    a = np.array([[2 ** 30 + 1, 2 ** 30 - 1]])
    assert exact_products(a, a).tolist() == [[2 ** 61 + 2]]
    assert exact_products(a[:0], a).shape == (0, 1) and exact_products(a[:, :0], a[:, :0]).tolist() == [[0]]


def test_nearest_takes_the_first_of_equals():
    book = np.array([[5, 5], [1, 1], [1, 1], [9, 9]])
    assert [x.tolist() for x in nearest(np.array([[1, 1], [3, 3], [100, 0]]), book)] == [
        [1, 0, 3], [0, 8, 91 ** 2 + 81]]
    huge = np.array([[10 ** 30, 0]], object)
    assert nearest(huge, np.array([[0, 0], [10 ** 30, 1]], object))[1].tolist() == [1]


def test_parts_cover_any_length():
    for width in range(12):
        assert [n for p in parts_of(width, 4) for n in range(p.start, p.stop)] == list(range(width))


def by_hand(rows, rounds, entries):
    """Codes, errors and components of ``(key, vector)`` rows, in Python's integers."""
    kept = [(k, [math.floor(1024 * x) for x in v]) for k, v in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, listed = [], []
    for width in sorted({len(v) for _, v in kept}):
        own = sorted((r for r in kept if len(r[1]) == width),
                     key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        codes, errors = [[] for _ in own], [0] * len(own)
        for part in parts_of(width, 4):
            points = [v[part] for _, v in own]
            book = [list(p) for p in points[:entries]]

            def at(p, book=book):
                return min((sum((a - b) ** 2 for a, b in zip(p, c, strict=True)), i)
                           for i, c in enumerate(book))
            for _ in range(rounds):
                held = defaultdict(list)
                for p in points:
                    held[at(p)[1]].append(p)
                for i, ps in held.items():
                    book[i] = [sum(c) // len(ps) for c in zip(*ps, strict=True)]
            listed += [x for c in book for x in c]
            for n, p in enumerate(points):
                error, code = at(p)
                errors[n] += error
                codes[n].append(code)
        out += [(k, bytes(c).hex(), min(e, 2 ** 63 - 1))
                for (k, _), c, e in zip(own, codes, errors, strict=True)]
    return Counter(out), listed


def test_codes_of_odd_vectors(spark):
    draw = random.Random(9)
    rows = [(i, [draw.choice([-1.5, 0.0, draw.gauss(0, 1)]) for _ in range(8)]) for i in range(60)]
    rows += [(3, rows[3][1]), (3, rows[4][1]), (3, rows[4][1]), (None, rows[5][1]), (70, None),
             (71, [float("nan")] * 8), (72, [float("inf")] + [0.0] * 7), (73, [None] * 8),
             (74, [1.0] * 6), (75, [2.0] * 6), (76, [-2.0] * 6), (77, []), (78, []),
             (79, [1e300] + [0.0] * 9), (80, [-1e300] + [0.5] * 9), (81, [3e9] * 10)]
    shape = "vec_id long, embedding array<double>, label int, code string, error string, row string"
    frame = spark.createDataFrame([(*r, 1, "c", "e", "r") for r in rows], shape).repartition(3)
    books = train_codebooks(frame, entries=7, rounds=4)
    want, listed = by_hand(rows, 4, 7)
    assert books.listed() == listed
    got = encode_vectors(frame, books).collect()
    assert Counter((r.vec_id, bytes(r.code).hex(), r.error) for r in got) == want
    none = frame.limit(0)
    empty = train_codebooks(none)
    assert empty.books == {} and encode_vectors(none, empty).count() == 0
    assert encode_vectors(frame, empty).count() == 0


def test_totals_by_label(spark):
    rows = [(i, i % 3 if i % 5 else None, 10 ** 18) for i in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, error long")
    total = defaultdict(int)
    for _, label, error in rows:
        total[label] += error
    got = with_total(frame, "error", "label", "label_error", "vec_id").collect()
    assert len(got) == 300
    assert all(r.label_error == min(total[r.label], 2 ** 63 - 1) for r in got)


def test_op13_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    want, listed = by_hand([(r.vec_id, r.embedding) for r in rows], 4, 256)
    label = {r.vec_id: r.label for r in rows}
    total = Counter()
    for key, _, error in want:
        total[label[key]] += error
    got = QUERIES["op13_vector_codes"](spark, SF).collect()
    assert Counter((r.vec_id, r.code, r.error) for r in got) == want
    assert all(r.label_error == total[label[r.vec_id]] for r in got)
    assert {r.codebooks_sha256 for r in got} == {sha(",".join(map(str, listed)))}
