import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from cases import ODD_TEXTS, SF
from postmill.llm.bindings import QUERIES, tokenizer
from postmill.llm.bpe import Recent, WordBpe, encode_texts
from postmill.llm.packing import best_fit, pack, pack_documents
from postmill.llm.token_counts import attribute, section_tokens
from pyspark.sql import functions as F
from tokenizers import Tokenizer

FILE = tokenizer()
ALPHABET = [*"AaŹ̈İΣσ \n\xa0 ᄀ'st0٠ﬁ中\U0001f389$\x85\x1c\x1f\x0bßẞ",
            "<|endoftext|>", "<|startoftext|>", "'s", "'RE", "<|", "hello", "World"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def own():
    with open(FILE, "rb") as f:
        raw = f.read()
    return WordBpe(raw), WordBpe(raw, "library")


def test_every_kind_of_character(library, own):
    points = [*range(0, 0x3000), *range(0x3000, 0x30000, 37), *range(0xE0000, 0xE0200, 5)]
    for c in points:
        if not 0xD800 <= c < 0xE000:
            text = f"a{chr(c)}b"
            assert own[0].encode(text).tolist() == library.encode(
                text, add_special_tokens=False).ids, hex(c)


def test_random_texts_and_round_trip(library, own):
    draw = random.Random(5)
    for _ in range(4000):
        text = "".join(draw.choice(ALPHABET) for _ in range(draw.randrange(14)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert own[0].encode(text).tolist() == own[1].encode(text).tolist() == ids
        assert own[0].decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_recent_forgets_but_answers():
    seen = []
    memo = Recent(lambda key: seen.append(key) or key.upper(), limit=2)
    assert [memo[k] for k in "abcabcdeab"] == list("ABCABCDEAB")
    assert len(memo) <= 2 and len(memo.old) <= 2


def test_encode_odd_texts(frame, library):
    rows = encode_texts(frame(ODD_TEXTS), FILE).collect()
    assert len(rows) == len(ODD_TEXTS)
    want = sorted((str(i), library.encode(t or "", add_special_tokens=False).ids) for i, t in ODD_TEXTS)
    assert sorted((str(r.doc_id), r.ids) for r in rows) == want
    assert all(r.decoded == library.decode(r.ids, skip_special_tokens=False) for r in rows)
    assert encode_texts(frame([]), FILE).count() == 0


def test_op4_whole_table(spark, documents, library):
    got = {r.doc_id: r for r in QUERIES["op4_bpe_codec"](spark, SF).collect()}
    for row in documents.collect():
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        r = got.pop(row.doc_id)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(decoded.encode()).hexdigest())
    assert not got


# --- packing ---------------------------------------------------------------------

def check_packing(rows, ids_of, size):
    by_doc = defaultdict(list)
    places = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for doc, own in by_doc.items():
        copies = len(own) // max(1, -(-len(ids_of[doc]) // size))
        want = [(n, at, len(ids_of[doc][at:at + size]),
                 zlib.crc32(np.array(ids_of[doc][at:at + size], "<u4").tobytes()))
                for n, at in enumerate(range(0, len(ids_of[doc]), size))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in own) == sorted(want * copies)
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert 0 < end <= size
    total = sum(r.length for r in rows)
    return len(places), -(-total // size)


def test_op9_whole_table(spark, documents, library):
    ids = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
           for r in documents.collect()}
    rows = QUERIES["op9_best_fit_packing"](spark, SF).collect()
    assert {r.doc_id for r in rows} == set(ids)
    used, least = check_packing(rows, ids, 2048)
    assert used <= least + 2


def test_pack_odd_texts(frame, library):
    alone = [p for p in ODD_TEXTS if p[0] not in (5, None)]
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in alone}
    rows = pack_documents(frame(alone), FILE, size=16, group_pieces=64).collect()
    check_packing(rows, ids, 16)
    rows = pack_documents(frame(ODD_TEXTS), FILE, size=16, group_pieces=64).collect()
    assert sum(r.length for r in rows if r.doc_id == 5) == 4
    assert sum(r.length for r in rows if r.doc_id is None) == 3
    assert pack_documents(frame([]), FILE).count() == 0


def test_local_search_never_loses_an_item_and_helps():
    draw = np.random.default_rng(3)
    better = 0
    for _ in range(20):
        lengths = draw.integers(300, 1100, 60)
        before = best_fit(lengths, 2048)
        after = pack(lengths, 2048)
        assert sorted(i for b in after for i in b) == list(range(60))
        assert all(lengths[b].sum() <= 2048 for b in after)
        assert len(after) <= len(before)
        better += sum(int(lengths[b].sum()) ** 2 for b in after) > sum(
            int(lengths[b].sum()) ** 2 for b in before)
    assert better > 10
    # A swap empties a bin that best fit leaves: 6+3, 5+5 and 1+1+... into full bins of 10.
    assert len(pack(np.array([5, 4, 4, 3, 2, 2]), 10)) == 2
    assert pack(np.zeros(0, int), 10) == []


def allowed_exchanges(left, right):
    """Fills moved from ``left`` to ``right`` by exchanges of at most three items."""
    sides = [[(sum(c), len(c)) for n in (0, 1, 2) for c in itertools.combinations(b, n)]
             for b in (left, right)]
    return {given - back for given, m in sides[0] for back, n in sides[1] if m and m + n <= 3}


@pytest.mark.parametrize(("size", "lengths"), [
    (118, [41, 46, 22, 26, 19, 29, 16, 43, 21, 13]),
    (83, [27, 29, 13, 11, 15, 33, 26, 12, 22, 9, 20, 30, 15, 15]),
    (102, [21, 24, 25, 37, 18, 21, 27, 23, 46, 28, 23, 18])])
def test_local_search_ends_where_no_exchange_helps(size, lengths):
    bins = [[lengths[i] for i in b] for b in pack(np.array(lengths), size)]
    for low, other in itertools.permutations(bins, 2):
        a, b = sum(low), sum(other)
        assert not [g for g in allowed_exchanges(low, other)
                    if 0 < g <= size - b and (a - g) ** 2 + (b + g) ** 2 > a * a + b * b]


# --- token counts ----------------------------------------------------------------

def test_rules_for_crossing_tokens():
    first, last = np.array([0, 5, 6]), np.array([5, 6, 9])
    start, stop = np.array([0, 3, 4, 4, 8, 9]), np.array([3, 6, 7, 9, 9, 12])
    assert attribute(start, stop, first, last, "majority").tolist() == [0, 0, 0, 2, 2, -1]
    assert attribute(start, stop, first, last, "first").tolist() == [0, 0, 0, 0, 2, -1]
    assert attribute(start, stop, first, last, "last").tolist() == [0, 1, 2, 2, 2, -1]
    none = np.zeros(0, int)
    assert attribute(start, stop, none, none, "majority").tolist() == [-1] * 6


def brute_sections(library, text):
    lines = (text or "").split("\n")
    bounds, at = [], 0
    for n, line in enumerate(lines):
        size = len(line) + (n < len(lines) - 1)
        bounds.append((at, at + size))
        at += size
    counts = [0] * len(bounds)
    for a, b in library.encode(text or "", add_special_tokens=False).offsets:
        shared = [min(b, y) - max(a, x) for x, y in bounds]
        counts[shared.index(max(shared))] += 1
    return [(n, x, y - x, c) for n, ((x, y), c) in enumerate(zip(bounds, counts, strict=True))]


@pytest.fixture(scope="module")
def byte_library():
    found = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return found


def test_op6_whole_table(spark, documents, byte_library):
    got = defaultdict(list)
    for r in QUERIES["op6_token_counts"](spark, SF).collect():
        got[r.doc_id].append((r.section, r.start, r.length, r.n_tokens))
    for row in documents.collect():
        assert sorted(got[row.doc_id]) == brute_sections(byte_library, row.text)


def test_sections_odd_texts(frame, byte_library):
    import public_tokenizers

    args = tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    texts = [(i, t) for i, t in ODD_TEXTS if i not in (5, 6, None)] + [(12, "a\n\n\n\nb  \n\n c\n")]
    got = defaultdict(list)
    for r in section_tokens(frame(texts), *args).collect():
        got[r.doc_id].append((r.section, r.start, r.length, r.n_tokens))
    for i, t in texts:
        assert sorted(got[i]) == brute_sections(byte_library, t), i
    assert section_tokens(frame([]), *args).count() == 0
    given = frame([(1, "one two three"), (2, "xy"), (3, None)]).withColumn("parts", F.expr(
        "if(doc_id = 1, array(named_struct('start', 4L, 'stop', 7L)), null)"))
    rows = section_tokens(given, *args, sections="parts").collect()
    assert sorted((r.doc_id, r.section, r.start, r.n_tokens) for r in rows if r.section is not None) \
        == [(1, 0, 4, 1)]
    assert sum(r.n_tokens for r in rows if r.doc_id == 1) == 3
