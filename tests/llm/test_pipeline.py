import hashlib
import re
from collections import Counter

import corpus_pipeline as p
import pytest
from cases import SF
from pyspark.sql import functions as F

from test_codec import check_packing  # noqa: E402
from test_dedup import brute_fingerprint, brute_lines, brute_repeats, groups_of
from tokenizers import Tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, documents):
    """Every stage's input and output, on the whole table and rows that stages must judge."""
    again = documents.select(F.max("doc_id")).first()[0] + 1
    extra = [(again, None, None, "x", 0), (again + 1, "", "en", "x", 0),
             (again + 2, "12 34 !!", "en", "x", 8)]
    docs = documents.unionByName(spark.createDataFrame(extra, documents.schema))
    out = []
    for name, stage in p.STAGES:
        after = spark.createDataFrame(
            stage(spark, docs, SF).collect(), stage(spark, docs, SF).schema).cache()
        out.append((name, docs, after))
        docs = after
    return {name: (before.collect(), after.collect()) for name, before, after in out}


def test_stages_in_order():
    assert [n for n, _ in p.STAGES] == [
        "language_id", "line_dedup", "simhash_dedup", "substring_dedup", "best_fit_packing"]


def texts(rows):
    return {r.doc_id: r.text for r in rows}


def test_language_stage_rejects_only_texts_without_letters(stages):
    before, after = stages["language_id"]
    assert after[0].__fields__ == COLUMNS
    gone = set(texts(before)) - set(texts(after))
    assert gone == {r.doc_id for r in before if not re.search(r"[^\W\d_]", r.text or "")}
    assert len(gone) >= 3 and all(texts(before)[i] == t for i, t in texts(after).items())


def test_language_stage_keeps_uncertain_texts(spark, documents):
    """Three languages taught the same: every score is near one third."""
    taught = [(n, "the cat and the dog", lang, "s", 19) for n, lang in enumerate(["aa", "bb", "cc"] * 8)]
    unsure = [(100, "the dog", None, "s", 7), (101, "the dog", "bb", "s", 7), (102, "12 34", "aa", "s", 5)]
    docs = spark.createDataFrame(taught + unsure, documents.schema)
    after = {r.doc_id: r.lang for r in p.identify_language(spark, docs, SF).collect()}
    assert set(after) == {*range(24), 100, 101}
    assert after[101] == "bb" and after[100] in ("aa", "bb", "cc")


def test_line_stage(stages):
    before, after = stages["line_dedup"]
    want = {}
    for i, kept, _, gone in brute_lines([(r.doc_id, r.text) for r in before]):
        if not gone or kept.strip(" "):
            want[i] = kept if gone else texts(before)[i]
    assert texts(after) == want


def test_near_stage(stages):
    before, after = stages["simhash_dedup"]
    prints = {r.doc_id: brute_fingerprint(r.text) for r in before}
    groups = groups_of(set(prints), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 2)
    assert set(texts(after)) == set(groups.values())
    assert all(n == 1 for n in Counter(groups[i] for i in texts(after)).values())


def test_near_stage_judges_rows_not_ids(spark, documents):
    first, second, third = (" ".join(f"{w}{n}" for n in range(200)) for w in "abc")
    rows = [(7, first, "en", "s", 1), (7, first, "en", "s", 1), (None, first, "en", "s", 1),
            (9, first, "de", "s", 1), (9, second, "en", "s", 1), (None, third, "en", "s", 1),
            (None, third, "en", "s", 1), (None, third, None, "s", 1)]
    after = p.dedup_near(spark, spark.createDataFrame(rows, documents.schema), SF).collect()
    assert {(r.doc_id, r.text) for r in after} == {(7, first), (9, second), (None, third)}
    assert len(after) == 3 and after[0].__fields__ == COLUMNS


def test_passage_stage(stages):
    before, after = stages["substring_dedup"]
    want = {}
    for i, kept, _, gone in brute_repeats([(r.doc_id, r.text) for r in before]):
        if not gone or kept:
            want[int(i)] = kept if gone else texts(before)[int(i)]
    assert texts(after) == want
    assert all(r.n_chars == len(r.text) for r in after)


def test_packing_stage(stages):
    before, after = stages["best_fit_packing"]
    library = Tokenizer.from_file(p.tokenizer())
    ids = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 0] for r in before}
    assert {r.doc_id for r in after} == set(ids)
    used, least = check_packing(after, ids, 2048)
    assert used <= least + 2


def test_run_equals_the_stages(spark, documents, stages):
    got = p.run(spark, SF).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in stages["best_fit_packing"][1]}
    digest = [hashlib.md5(str(sorted((r.doc_id, r.piece, r.ids_crc32) for r in rows)).encode()).digest()
              for rows in (got, stages["best_fit_packing"][1])]
    assert digest[0] == digest[1]


def test_empty_table_passes_through(spark, documents, tmp_path):
    documents.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0


def test_stages_on_odd_rows(spark, documents):
    """Null ids, repeated rows, very long texts and columns that clash with a stage's own."""
    passage = " ".join(f"word{n}" for n in range(80))
    lines = "\n".join(f"a line number {n}" for n in range(40))
    rows = [(1, passage), (1, passage), (2, f"before {passage}"), (None, passage), (None, None), (3, ""),
            (4, "x" * 60_000), (5, "alpha beta gamma delta\n" * 4000), (6, lines), (7, lines), (None, lines),
            (8, "Ünïcode Σας <|endoftext|>"), (9, "12 34")]
    clash = "kept_text n_removed n_lines n_words lang_pred score row component_id ids".split()
    plain = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], documents.schema)
    docs = plain.withColumns({c: F.lit("clash") for c in clash})

    def after(name):
        out = dict(p.STAGES)[name](spark, docs, SF)
        assert name == "best_fit_packing" or out.columns == COLUMNS
        return out.collect()

    kept = Counter((r.doc_id, r.text) for r in after("language_id"))
    assert kept == Counter((i, t) for i, t in rows if t and re.search(r"[^\W\d_]", t))
    got = after("line_dedup")
    assert {r.doc_id for r in got} == {1, 2, 3, 4, 5, 6, 8, 9, None}  # the later copy goes whole
    assert sum(r.doc_id is None for r in got) == 3 and sum(r.doc_id == 1 for r in got) == 2
    got = after("simhash_dedup")
    assert sum(r.text == passage for r in got) == 1 and sum(r.text == lines for r in got) == 1
    assert {r.doc_id for r in got} >= {1, 4, 5, 6, 8, 9}
    got = after("substring_dedup")
    assert [r.text for r in got if r.doc_id == 2] == ["before"]
    assert sum(r.text == passage for r in got) == 3
    got = after("best_fit_packing")
    assert {r.doc_id for r in got} == {i for i, _ in rows}
    assert sum(r.length for r in got if r.doc_id == 1) % 2 == 0


def test_run_leaves_its_output_alone(spark):
    """Scratch tables of all stages are gone once the last result is written."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.conf.get("spark.checkpoint.dir"))
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def listed(path):
        return {s.getPath().toString() for s in fs.listStatus(path)} if fs.exists(path) else set()

    before = listed(folder)
    got = p.run(spark, SF)
    left = listed(folder) - before
    assert len(left) == 1 and "/pipeline-" in next(iter(left))
    tables = listed(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(next(iter(left))))
    assert len(tables) == 1 and got.count() > 0
