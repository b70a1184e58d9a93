import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from cases import ODD_TEXTS, SF
from postmill.llm.bindings import QUERIES
from postmill.llm.common import Scratch
from postmill.llm.components import connected
from postmill.llm.exact_dedup import exact_duplicates
from postmill.llm.line_chunks import remove_repeated_chunks
from postmill.llm.simhash import (
    _cell, _steps, block_masks, compare_tiles, fingerprint, near_duplicates,
)
from postmill.llm.substring import remove_repeats
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def groups_of(items, linked):
    """Smallest member of every item's group, by trying all pairs."""
    parent = {i: i for i in items}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    items = sorted(items)
    for n, a in enumerate(items):
        for b in items[n + 1:]:
            if linked(a, b):
                low, high = sorted((top(a), top(b)))
                parent[high] = low
    return {i: top(i) for i in items}


# --- exact -------------------------------------------------------------------------

@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_odd_texts(frame, keep):
    rows = exact_duplicates(frame(ODD_TEXTS), keep=keep).collect()
    assert len(rows) == len(ODD_TEXTS)
    groups = defaultdict(list)
    for i, t in ODD_TEXTS:
        groups[lowered(t)].append(i)
    best = {"min": min, "max": max}[keep]
    for r in rows:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        known = [i for i in groups[text] if i is not None]
        assert r.doc_id in groups[text] and r.group_size == len(groups[text])
        assert r.keep_id == (best(known) if known else None)
        assert r.kept == (r.doc_id == r.keep_id)
    assert exact_duplicates(frame([])).count() == 0


def test_exact_tells_colliding_hashes_apart(frame, monkeypatch):
    """With a hash that always collides, the bytes decide."""
    from postmill.llm import exact_dedup

    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: F.lit("00" * 16))
    rows = exact_duplicates(frame([(1, "a"), (2, "b"), (3, "A"), (4, "c"), (5, "b")], False)).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in rows) == [
        (1, 1, 2), (2, 2, 2), (3, 1, 2), (4, 4, 1), (5, 2, 2)]


# --- near duplicates ---------------------------------------------------------------

def brute_fingerprint(text, width=3):
    words = WORDS.findall(lowered(text))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_texts():
    """Chains and groups of texts a few bits apart, found by changing single words."""
    draw = np.random.default_rng(9)
    words = [f"w{n}" for n in range(400)]
    texts = []
    for _ in range(12):
        base = draw.choice(words, 300).tolist()
        for _ in range(12):
            texts.append(" ".join(base))
            for _ in range(draw.integers(1, 4)):
                base[draw.integers(300)] = str(draw.choice(words))
    return [(n, t) for n, t in enumerate(texts)]


def test_fingerprint_of_whole_texts():
    for _, text in ODD_TEXTS + near_texts()[:5]:
        assert fingerprint(text, 3) % (1 << 64) == brute_fingerprint(text)


@pytest.mark.parametrize("tile_rows", [3, 4096])
def test_near_duplicates_find_every_link(frame, tile_rows):
    texts = near_texts() + [(1000 + i, t) for i, t in ODD_TEXTS if i is not None]
    prints = {i: brute_fingerprint(t) for i, t in texts}
    want = groups_of(set(prints), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 2)
    rows = near_duplicates(frame(texts), tile_rows=tile_rows).collect()
    assert len(rows) == len(texts)
    assert {r.doc_id: r.component_id for r in rows} == want
    assert len(set(want.values())) < len(set(prints.values())) < len(prints)


def test_near_duplicates_odd_texts(frame):
    rows = near_duplicates(frame(ODD_TEXTS)).collect()
    by_id = defaultdict(set)
    for r in rows:
        by_id[r.doc_id].add(r.component_id)
    assert len(rows) == len(ODD_TEXTS)
    assert by_id[1] == by_id[2] == by_id[3] == {1} and by_id[5] == {4} and by_id[None] == {1, 4}
    assert near_duplicates(frame([])).count() == 0


@pytest.mark.parametrize("blocks", [4, 5, 7])
def test_cells_of_close_fingerprints_are_steps_apart(spark, blocks):
    draw = np.random.default_rng(blocks)
    masks = [m % (1 << 64) for m in block_masks(blocks)]
    assert sum(masks) == (1 << 64) - 1
    pairs = []
    for _ in range(200):
        a = int(draw.integers(0, 1 << 63, dtype=np.uint64)) << 1 | 1
        b = a
        for bit in draw.integers(0, 64, 2).tolist():
            b ^= 1 << bit
        pairs.append([x - (1 << 64) if x >> 63 else x for x in (a, b)])
    rows = spark.createDataFrame(pairs, "a long, b long").select(
        (_cell(F.col("b"), blocks, 2) - _cell(F.col("a"), blocks, 2)).alias("step")).collect()
    steps = _steps(blocks, 2)
    assert len(steps) == len(set(steps))
    assert all(r.step in steps or -r.step in steps for r in rows)


def test_tiles_keep_all_groups():
    draw = np.random.default_rng(11)
    left = draw.integers(0, 1 << 10, 400, dtype=np.uint64)
    right = draw.integers(0, 1 << 10, 300, dtype=np.uint64)
    u, v = compare_tiles(np.unique(left), np.unique(right), 2)
    both = {*left.tolist(), *right.tolist()}
    own, other = set(left.tolist()), set(right.tolist())
    close = {(a, b) for a in own for b in other if bin(a ^ b).count("1") <= 2}
    want = groups_of(both, lambda a, b: (a, b) in close or (b, a) in close)
    got = groups_of(both, lambda a, b, links=set(zip(u.tolist(), v.tolist(), strict=True)):
                    (a, b) in links or (b, a) in links)
    assert got == want


def test_components_of_chains_and_stars(spark):
    links = [(n, n + 1) for n in range(0, 60)] + [(100, n) for n in range(101, 160)] + [(7, 7), (200, 199)]
    got = connected(spark.createDataFrame(links, "u long, v long"), Scratch(spark, "t")).collect()
    want = {**{n: 0 for n in range(61)}, **{n: 100 for n in range(100, 160)}, 199: 199, 200: 199}
    assert {r.node: r.root for r in got} == want and len(got) == len(want)


# --- lines -------------------------------------------------------------------------

def line_chunks(text, mean=3):
    lines = (text or "").split("\n")
    hashes = [hashlib.md5(x.encode()).hexdigest() for x in lines]
    rolled = [int(hashlib.md5((before + own).encode()).hexdigest()[:8], 16)
              for before, own in zip(["", *hashes], hashes, strict=False)]
    out, start, reach = [], 0, max(1, mean // 2)
    for n in range(len(lines)):
        around = rolled[max(0, n - reach):n] + rolled[n + 1:n + 1 + reach]
        if n == len(lines) - 1 or 0 < n < len(lines) - 2 and rolled[n] < min(around):
            out.append(lines[start:n + 1])
            start = n + 1
    return out


def brute_lines(texts, mean=3):
    def chunks(text):
        return line_chunks(text, mean)

    seen, out = set(), []
    for i, text in sorted(texts, key=lambda p: p[0]):
        kept, gone = [], 0
        for chunk in chunks(text):
            if len(chunk) > 1 and tuple(chunk) in seen:
                gone += len(chunk)
            else:
                kept += chunk
            if len(chunk) > 1:
                seen.add(tuple(chunk))
        out.append((i, "\n".join(kept), len((text or "").split("\n")), gone))
    return out


def test_line_chunks_whole_table_and_planted(frame, documents):
    texts = [(r.doc_id, r.text) for r in documents.collect()]
    block = "\n".join(f"shared line {n}" for n in range(20))
    texts += [(5000 + n, f"own {n}\n" * (n % 4) + block + f"\nend {n}") for n in range(10)]
    texts += [(6000, block + "\n" + block)]
    got = remove_repeated_chunks(frame(texts)).collect()
    want = brute_lines(texts)
    assert sorted((r.doc_id, r.kept_text, r.n_lines, r.n_removed) for r in got) == want
    assert sum(n for i, _, _, n in want if i > 5000) > 100
    assert {r.row for r in got} == {"clash"}


@pytest.mark.parametrize("mean", [2, 5, 9])
def test_line_chunks_of_other_lengths(frame, mean):
    draw = np.random.default_rng(mean)
    shared = [f"line {n}" for n in draw.integers(0, 400, 300)]
    texts = [(i, "\n".join([f"own {i}"] * int(draw.integers(0, 3)) + shared[int(a):int(a) + int(n)] + ["end"] * (i % 2)))
             for i, (a, n) in enumerate(zip(draw.integers(0, 250, 40), draw.integers(0, 60, 40), strict=True))]
    got = remove_repeated_chunks(frame(texts), mean_lines=mean).collect()
    assert sorted((r.doc_id, r.kept_text, r.n_lines, r.n_removed) for r in got) == brute_lines(texts, mean)
    assert all(len(c) > 1 for _, t in texts if "\n" in t for c in line_chunks(t, mean))


def test_whole_copies_and_most_repeated_lines_go(spark):
    """Exact copies go whole; of lines in repeated runs of two or more at least three quarters."""
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    texts = sorted((r.doc_id, (r.text or "").split("\n")) for r in docs.collect())
    gone = {r.doc_id: r.n_removed for r in remove_repeated_chunks(docs).collect()}
    seen, first, repeated = set(), {}, 0
    for i, lines in texts:
        for pair in zip(lines, lines[1:], strict=False):
            first.setdefault(pair, i)
    for i, lines in texts:
        if len(lines) > 1:
            if tuple(lines) in seen:
                assert gone[i] == len(lines)
            seen.add(tuple(lines))
        held = [first[p] < i for p in zip(lines, lines[1:], strict=False)]
        repeated += sum(a or b for a, b in zip([False, *held], [*held, False], strict=True))
    assert repeated > 500 and sum(gone.values()) >= 0.75 * repeated


def test_line_chunks_odd_texts(frame):
    again = "\n".join(f"line {n}" for n in range(12))
    texts = [*ODD_TEXTS, (30, again), (31, again), (31, again), (None, again), (32, again + "x")]
    rows = remove_repeated_chunks(frame(texts)).collect()
    assert len(rows) == len(texts)
    by_id = defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append(r)
    assert by_id[30][0].kept_text == again and by_id[30][0].n_removed == 0
    assert {r.n_removed for r in by_id[31]} == {by_id[31][0].n_removed} and by_id[31][0].n_removed > 0
    assert all(r.n_removed == 0 for r in by_id[None])
    assert by_id[1][0].kept_text == "" and by_id[2][0].n_lines == 1 and by_id[3][0].kept_text == " \n\t "
    alone = [p for p in texts if p[0] is not None and p[0] != 31]
    for i, kept, n_lines, gone in brute_lines(alone):
        assert (by_id[i][0].kept_text, by_id[i][0].n_lines, by_id[i][0].n_removed) == (kept, n_lines, gone)
    assert remove_repeated_chunks(frame([])).count() == 0


# --- passages ----------------------------------------------------------------------

def brute_repeats(texts, window=50):
    words = [(i, WORDS.findall(t or "")) for i, t in texts]
    first = {}
    for i, own in sorted(((i, w) for i, w in words if i is not None), key=lambda p: p[0]):
        for n in range(len(own) - window + 1):
            first.setdefault(tuple(own[n:n + window]), i)
    out = []
    for i, own in words:
        gone = set()
        for n in range(len(own) - window + 1) if i is not None else ():
            if first[tuple(own[n:n + window])] < i:
                gone |= set(range(n, n + window))
        out.append((str(i), " ".join(w for n, w in enumerate(own) if n not in gone), len(own), len(gone)))
    return sorted(out)


def planted_passages():
    draw = np.random.default_rng(21)
    fresh = (f"u{n}" for n in range(10 ** 6))
    shared = [next(fresh) for _ in range(400)]
    texts = []
    for n in range(60):
        a, size = int(draw.integers(0, 300)), int(draw.integers(40, 100))
        before = [next(fresh) for _ in range(draw.integers(0, 60))]
        after = [next(fresh) for _ in range(draw.integers(0, 60))]
        texts.append((n, " \n".join([*before, *shared[a:a + size], *after])))
    texts += [(70, " ".join(shared)), (71, " ".join(shared)), (72, " ".join(["same"] * 500)),
              (73, " ".join(["same"] * 120)), (74, " ".join(["same"] * 49)),
              (75, " ".join(shared[:50])), (76, " ".join(shared[:49]))]
    return texts


def test_passages_planted_and_odd(frame):
    texts = [*planted_passages(), *[(i and 100 + i, t) for i, t in ODD_TEXTS],
             (None, planted_passages()[0][1]), (71, planted_passages()[-6][1])]
    rows = remove_repeats(frame(texts)).collect()
    got = sorted((str(r.doc_id), r.kept_text, r.n_words, r.n_removed) for r in rows)
    assert got == brute_repeats(texts)
    assert {r.spans for r in rows} == {"clash"}
    assert sum(r.n_removed for r in rows) > 1000
    assert remove_repeats(frame([])).count() == 0


def test_op10_whole_table(spark, documents):
    texts = [(r.doc_id, r.text) for r in documents.collect()]
    rows = QUERIES["op10_substring_dedup"](spark, SF).collect()
    got = sorted((str(r.doc_id), r.kept_sha256, r.n_words, r.n_removed) for r in rows)
    assert got == [(i, hashlib.sha256(t.encode()).hexdigest(), n, g)
                   for i, t, n, g in brute_repeats(texts)]
    assert sum(r.n_removed for r in rows) > 0


def test_op3_whole_table(spark, documents):
    prints = {r.doc_id: brute_fingerprint(r.text) for r in documents.collect()}
    want = groups_of(set(prints), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 2)
    rows = QUERIES["op3_simhash_dedup"](spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {
        i: (f"{prints[i]:016x}", want[i]) for i in prints}
    assert max(Counter(want.values()).values()) > 1
