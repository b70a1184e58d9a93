import itertools
import math

import numpy as np
import pytest
from cases import ODD_TEXTS, SF
from postmill.llm import language, quality
from postmill.llm.bindings import QUERIES, tokenizer
from postmill.llm.common import held_out
from pyspark.sql import functions as F

VOCABULARY = tokenizer("piece_bpe_32k.model")


# --- quality -----------------------------------------------------------------------

def brute_marginals(scores, change):
    total, good = 0.0, [0.0] * len(scores)
    for labels in itertools.product((0, 1), repeat=len(scores)):
        weight = math.exp(sum(s for s, y in zip(scores, labels, strict=True) if y) + sum(
            change[a][b] for a, b in itertools.pairwise(labels)))
        total += weight
        for i, y in enumerate(labels):
            good[i] += y * weight
    return [g / total for g in good]


def test_marginals_sum_over_all_labellings():
    draw = np.random.default_rng(1)
    for n in range(1, 8):
        scores, change = draw.normal(0, 2, n).tolist(), draw.normal(0, 1, (2, 2)).tolist()
        assert quality.marginals(scores, change) == pytest.approx(brute_marginals(scores, change))
    assert all(0 <= p <= 1 for p in quality.marginals([900.0, -900.0, 0.0] * 500, [[9, -9], [-9, 9]]))


def test_gradient_is_that_of_the_likelihood(monkeypatch):
    monkeypatch.setattr(quality, "RIDGE", 0.0)
    draw = np.random.default_rng(2)
    x, there = draw.normal(0, 1, (3, 4, 5)), np.ones((3, 4), bool)
    there[1, 2:] = False
    x[~there] = 0
    label = np.array([1, 0, 1])
    model = quality.QualityModel(draw.normal(0, 1, 5), draw.normal(0, 1, (2, 2)))

    def likelihood(weights, change):
        out = 0.0
        for i in range(3):
            n = there[i].sum()
            scores = x[i, :n] @ weights
            total = sum(math.exp(sum(s * y for s, y in zip(scores, ys, strict=True)) + sum(
                change[a][b] for a, b in itertools.pairwise(ys)))
                for ys in itertools.product((0, 1), repeat=n))
            own = label[i]
            out += scores.sum() * own + (n - 1) * change[own][own] - math.log(total)
        return out / there.sum()

    by_weight, by_change = quality._gradient(model, x, there, label)
    for k in range(5):
        step = np.eye(5)[k] * 1e-5
        slope = (likelihood(model.weights + step, model.change)
                 - likelihood(model.weights - step, model.change)) / 2e-5
        assert by_weight[k] == pytest.approx(slope, abs=1e-6)
    step = np.array([[0, 1e-5], [0, 0]])
    slope = (likelihood(model.weights, model.change + step)
             - likelihood(model.weights, model.change - step)) / 2e-5
    assert by_change[0, 1] == pytest.approx(slope, abs=1e-6)


def test_line_features_and_neighbours():
    rows, sizes, per_text = quality.line_features(["ab cd\n\nAb ab ab!", None, ""])
    assert per_text.tolist() == [3, 1, 1] and sizes.tolist() == [5, 0, 9, 0, 0]
    assert rows[0][0] == pytest.approx(4 / 5) and rows[2][6] == pytest.approx(1 / 9)
    both = quality.with_neighbours(rows, per_text)
    width = quality.WIDTH
    assert (both[1, width:2 * width] == rows[0]).all() and (both[1, 2 * width:3 * width] == rows[2]).all()
    assert not both[3, width:3 * width].any() and (both[:, -1] == 1).all()
    assert quality.line_features([])[0].shape == (0, width)


def test_line_features_do_not_depend_on_the_blocks(monkeypatch):
    texts = ["Ab, c|d!\n" * 5 + "é" * 40 + "\nx\n\n", "", "one line 12"]
    whole = quality.line_features(texts)[0]
    monkeypatch.setattr(quality, "BLOCK_BYTES", 16)
    assert np.array_equal(quality.line_features(texts)[0], whole)


def test_op1_on_held_out_documents(spark):
    d = SF.replace("0.001", "0.01")
    got = QUERIES["op1_quality_classifier"](spark, d)
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 60 and {r.predicted for r in rows} == {0, 1}
    assert sum(r.predicted == r.quality for r in rows) / len(rows) >= 0.95
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    assert got.count() == spark.read.parquet(f"{d}/documents.parquet").count()


def test_quality_odd_texts(spark, frame):
    docs = frame(ODD_TEXTS)
    labels = spark.createDataFrame(
        [(4, 1), (4, 0), (8, 0), (9, 1), (None, 1), (7, None), (99, 1)], "doc_id long, quality int")
    for known in (labels, labels.filter("quality = 1"), labels.limit(0)):
        rows = quality.score(docs, quality.fit(docs, known)).collect()
        assert len(rows) == len(ODD_TEXTS) and all(0 <= r.score <= 1 for r in rows)
        same = {r.score for r in rows if r.doc_id in (1, 2)}
        assert len(same) == 1
    assert quality.score(frame([]), quality.fit(frame([]), labels)).count() == 0


# --- language ----------------------------------------------------------------------

def test_forward_sums_all_segmentations():
    lattice = language.Lattice(sorted({language.START, "a", "b", "ab", "ba", "▁a", "aba"}))
    chance = np.random.default_rng(4).random(lattice.unknown + 1).tolist()
    pieces = {p: i for i, p in enumerate(sorted({language.START, "a", "b", "ab", "ba", "▁a", "aba"}))}

    def brute(text):
        if not text:
            return 1.0
        out = 0.0
        for n in range(1, len(text) + 1):
            if text[:n] in pieces:
                out += chance[pieces[text[:n]]] * brute(text[n:])
        if text[0] not in pieces:
            out += chance[-1] * brute(text[1:])
        return out

    for word in ("a", "ab", "ababa", "axb", "zz", "bababab"):
        at, scale = lattice.forward(lattice.edges(word), len(word) + 1, chance)
        assert math.log(at[-1]) + scale == pytest.approx(math.log(brute(language.START + word)))
    at, scale = lattice.forward(lattice.edges("ab" * 5000), 10_001, [c / 50 for c in chance])
    assert math.isfinite(math.log(at[-1]) + scale)


def test_expected_counts_add_up():
    names = sorted({language.START, "a", "b", "ab"})
    lattice = language.Lattice(names)
    out = np.zeros(len(names) + 1)
    language.add_expected(lattice, "abab", 3, [0.2] * len(out), out)
    characters = sum(len(p) * n for p, n in zip(names, out, strict=False))
    assert characters == pytest.approx(3 * 5)


def test_expected_counts_of_long_words():
    names = sorted({language.START, "a", "b", "ab"})
    lattice = language.Lattice(names)
    for chance in (0.2, 1e-6):
        for word in ("ab" * 30, "ab" * 4000, "axb" * 500):
            out = np.zeros(len(names) + 1)
            language.add_expected(lattice, word, 2, [chance] * len(out), out)
            characters = sum(len(p) * n for p, n in zip(names, out, strict=False)) + out[-1]
            assert characters == pytest.approx(2 * (len(word) + 1))
    short, by_logs = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    language.add_expected(lattice, "abab", 3, [0.2] * len(short), short)
    language.add_expected_logs(lattice.edges("abab"), 5, 3, [0.2] * len(short), by_logs)
    assert by_logs == pytest.approx(short)


def test_languages_of_long_runs_are_learned(spark):
    """Texts without blanks: every run of letters is longer than forty."""
    thick = "derhundunddiekatze" * 5
    taught = spark.createDataFrame(
        [(1, "the cat and the dog", "en"), (2, thick, "de")], "doc_id long, text string, lang string")
    model = language.fit(taught, VOCABULARY)
    assert model.languages == ["de", "en"]
    rows = language.predict(taught, model).collect()
    assert {r.doc_id: r.lang_pred for r in rows} == {1: "en", 2: "de"}


def test_op7_on_held_out_documents(spark):
    d = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = QUERIES["op7_language_id"](spark, d)
    rows = got.join(docs, "doc_id").filter("held_out AND lang IS NOT NULL").collect()
    assert len(rows) > 150
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) >= 0.98
    assert got.count() == docs.count()
    # Nothing but text and labels outside the fold teaches: other labels change no answer.
    hidden = docs.withColumn("lang", F.when(held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    model = language.fit(hidden.filter(~held_out(F.col("doc_id"))), VOCABULARY)
    assert "xx" not in model.languages


def test_language_odd_texts(spark, frame):
    taught = spark.createDataFrame(
        [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, "...", "zz"),
         (4, None, "en"), (5, "no language", None)], "doc_id long, text string, lang string")
    model = language.fit(taught, VOCABULARY)
    assert model.languages == ["de", "en"]
    rows = language.predict(frame([*ODD_TEXTS, (20, "der hund"), (21, "The CAT")]), model).collect()
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == len(ODD_TEXTS) + 2 and all(0 <= r.score <= 1 for r in rows)
    assert [(by_id[i].lang_pred, by_id[i].score) for i in (1, 2, 3, 8)] == [("und", 0.0)] * 4
    assert (by_id[20].lang_pred, by_id[21].lang_pred) == ("de", "en")
    nothing = language.fit(taught.filter("lang = 'none'"), VOCABULARY)
    assert {r.lang_pred for r in language.predict(frame(ODD_TEXTS), nothing).collect()} == {"und"}
    assert language.predict(frame([]), model).count() == 0


# --- results from scratch, for a given model -------------------------------------------

def test_quality_scores_from_scratch(frame):
    """Every labelling of every text, its share weighted by bytes and one per line."""
    draw = np.random.default_rng(12)
    model = quality.QualityModel(
        draw.normal(0, 0.7, 3 * quality.WIDTH + 1), draw.normal(0, 1, (2, 2)), 1.7, -0.4)
    texts = [(1, "one line"), (2, "First line.\nsecond | line\n\nTHE END!"), (3, ""), (4, None),
             (5, "a\n\nb b b\n12 34\n  \nend."), (6, "ä\nß\nplain")]
    got = {r.doc_id: r.score for r in quality.score(frame(texts), model).collect()}
    for key, text in texts:
        lines = (text or "").split("\n")
        own = [quality.line_features([line])[0][0] for line in lines]
        none = np.zeros(quality.WIDTH)
        scores = [float(np.concatenate([
            own[i], own[i - 1] if i else none, own[i + 1] if i + 1 < len(own) else none, [1.0],
        ]) @ model.weights) for i in range(len(lines))]
        weight = [len(line.encode()) + 1 for line in lines]
        share = sum(w * g for w, g in zip(
            weight, brute_marginals(scores, model.change.tolist()), strict=True)) / sum(weight)
        odds = 1.7 * math.log(share / (1 - share)) - 0.4
        assert got[key] == pytest.approx(1 / (1 + math.exp(-odds)), abs=1e-9)


def test_quality_fit_takes_a_bounded_sample(spark, frame):
    """More runs than asked for are drawn by hash; the answer stays one for all texts."""
    good = "A fine sentence about rivers.\nAnother one follows it.\n" * 30
    bad = "||| !!! 00 ###\n| | | |\n" * 60
    docs = frame([(i, good if i % 2 else bad) for i in range(60)] + [(1, good)] * 20)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    for runs in (16_000, 40):
        model = quality.fit(docs, labels, sample_docs=30, sample_runs=runs)
        rows = quality.score(docs, model).collect()
        assert all((r.score > 0.5) == bool(r.doc_id % 2) for r in rows)


def test_languages_from_scratch(frame):
    """Every segmentation of every word, added up in plain numbers."""
    pieces = sorted({language.START, "a", "b", "ab", "▁a", "ba", "aba", "▁ab"})
    draw = np.random.default_rng(13)
    model = language.LanguageModel(["x", "y", "z"], pieces, draw.random((3, len(pieces) + 1)) / 9)

    def total(text, chance):
        if not text:
            return 1.0
        found = sum(chance[i] * total(text[len(p):], chance)
                    for i, p in enumerate(pieces) if text.startswith(p))
        return found if text[0] in pieces else found + chance[-1] * total(text[1:], chance)

    texts = [(1, "ab"), (2, "Aba, bab!"), (3, "ax ab-ba"), (4, "bbbbbb a b ab"), (5, "12"), (6, None),
             (7, "aBABAbab zz")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(frame(texts), model).collect()}
    for key, text in texts:
        words = language.words_of(text)
        if not words:
            assert got[key] == ("und", 0.0)
            continue
        odds = [math.prod(total(language.START + w, c.tolist()) for w in words) for c in model.chance]
        best = max(range(3), key=odds.__getitem__)
        assert got[key][0] == model.languages[best]
        assert got[key][1] == pytest.approx(odds[best] / sum(odds))
