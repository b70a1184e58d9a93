import datetime as dt
import math
import random

import pytest
from helpers import NOW, application, posting, posting_row
from postmill.operators import feedback as fb
from postmill.operators.knn import knn_topk, knn_topk_many, usable_vectors
from postmill.plans.recommend import (
    Request, hit_ids, pin_hits, recommend, rerank_with_scores, shortlist,
)
from pyspark.sql import functions as F


def texts(spark, rows):
    """(id, text, status) -> posting and application frames."""
    stored = posting(spark, *[posting_row(i, description=text) for i, text, _ in rows])
    return stored, application(spark, *[(i, s) for i, _, s in rows if s])


def deltas(frame):
    return {r.category: r.delta for r in frame.collect()}


def test_skill_negative_and_ubiquitous(spark):
    rows = [(i, "WordPress PHP", "dismissed") for i in (1, 2, 3)] + [(i, "PHP backend", "applied") for i in (4, 5)]
    p, a = texts(spark, rows)
    assert deltas(fb.skill_feedback(p, a, ["WordPress", "PHP"])) == {"wordpress": -10}
    assert deltas(fb.skill_feedback(p, a, [])) == {}


def test_skill_below_sample_size(spark):
    p, a = texts(spark, [(1, "Rust", "dismissed"), (2, "Rust", "dismissed"), (3, "Go", "applied")])
    assert deltas(fb.skill_feedback(p, a, ["Rust"])) == {}


def test_margin_is_the_plain_float_comparison(spark):
    """0.7 - 0.4 is below 0.3 in floats, so no signal."""
    rows = [(i, "tool", "dismissed" if i < 7 else "saved") for i in range(10)]
    rows += [(10 + i, "other", "dismissed" if i < 1 else "saved") for i in range(10)]
    p, a = texts(spark, rows)
    assert 7 / 10 - 8 / 20 < 0.3
    assert deltas(fb.skill_feedback(p, a, ["tool"])) == {}


def test_remote(spark):
    stored = posting(spark, *[posting_row(i, remote=i <= 3) for i in range(1, 6)])
    liked = application(spark, (1, "applied"), (2, "applied"), (3, "applied"), (4, "dismissed"), (5, "dismissed"))
    assert deltas(fb.remote_feedback(stored, liked)) == {"remote": 10}
    onsite = application(spark, (4, "applied"), (5, "applied"))
    assert deltas(fb.remote_feedback(stored, onsite)) == {}


def test_seniority_uses_the_first_level_of_the_title(spark):
    titles = ["Senior Lead"] * 3 + ["Junior dev"] * 3
    stored = posting(spark, *[posting_row(i, title=t) for i, t in enumerate(titles)])
    decided = application(spark, *[(i, "rejected" if i < 3 else "saved") for i in range(6)])
    assert deltas(fb.seniority_feedback(stored, decided)) == {"senior": -10, "junior": 10}


def test_excluded_companies(spark):
    names = ["Acme", " ACME ", "Beta", "beta", "", "  "]
    stored = posting(spark, *[posting_row(i, company=n) for i, n in enumerate(names)])
    decided = application(spark, (0, "dismissed"), (1, "rejected"), (2, "dismissed"), (3, "saved"),
                          (4, "dismissed"), (5, "dismissed"))
    assert {r.company_key for r in fb.excluded_companies(stored, decided).collect()} == {"acme"}
    only = spark.createDataFrame([("beta",)], "company_key string")
    assert fb.excluded_companies(stored, decided, only).count() == 0


def test_one_summary_equals_the_single_signals(spark):
    rows = [(i, f"word{i % 3} text", "dismissed" if i % 3 else "saved") for i in range(12)]
    p, a = texts(spark, rows)
    words = ["word0", "word1", "text"]
    signals, excluded = fb.decision_summary(p, a, words, ["acme", "other"])
    assert signals == {("skill", c): d for c, d in deltas(fb.skill_feedback(p, a, words)).items()}
    assert signals and excluded == []
    only_bad = a.filter("status = 'dismissed'")
    assert fb.decision_summary(p, only_bad, words, ["acme", ""])[1] == ["acme"]
    assert fb.decision_summary(p, a.limit(0), words, ["acme"]) == ({}, [])


def vectors(n=300, dims=8, seed=5):
    rng = random.Random(seed)
    rows = [(i, f"s{i % 3}", [rng.uniform(-1, 1) for _ in range(dims)]) for i in range(n)]
    return rows + [(n + i, "s0", rows[0][2]) for i in range(60)] + [(n + 100, "s1", [0.0] * dims)]


def brute(rows, query, k, sources=None):
    def score(v):
        dot = sum(a * b for a, b in zip(v, query, strict=True))
        norm = math.sqrt(sum(a * a for a in v)) * math.sqrt(sum(b * b for b in query))
        return (1 + dot / norm) / 2
    kept = [(round(-score(v), 9), i) for i, s, v in rows if any(v) and (not sources or s in sources)]
    return [i for _, i in sorted(kept)[:k]]


@pytest.mark.parametrize("sources", [None, ["s1", "s2"]])
def test_knn_is_exact(spark, sources):
    """Sixty copies of one vector tie: the lowest ids win."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    rows = vectors()
    index = spark.createDataFrame(rows, "vacancy_id bigint, source string, embedding array<float>").repartition(5)
    as_float = [(i, s, [float(x) for x in v]) for i, s, v in index.collect()]
    query = as_float[0][2]
    query = next(v for i, _, v in as_float if i == 0)
    got = [r.vacancy_id for r in knn_topk(index, query, 25, sources).collect()]
    assert got == brute(as_float, query, 25, sources)
    asked = spark.createDataFrame(
        [(1, query), (2, as_float[7][2]), (3, None), (4, [1.0])], "profile_id bigint, embedding array<float>")
    for few in (1000, 0):  # queries that go to the one scan, and blocks of both sides
        frame = knn_topk_many(index, asked, 10, 8, sources, block_rows=50, few_queries=few)
        many = frame.collect()
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert ("Join" in plan) == (few == 0)
        assert {r.profile_id for r in many} == {1, 2}
        for pid, vec in ((1, query), (2, as_float[7][2])):
            mine = [r.vacancy_id for r in sorted((r for r in many if r.profile_id == pid), key=lambda r: r.rank)]
            assert mine == brute(as_float, vec, 10, sources)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_blocks_of_queries_stay_off_the_driver(spark):
    """Neither side of the block join is broadcast, however small Spark takes it to be."""
    index = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(40)], "vacancy_id bigint, embedding array<float>")
    frame = knn_topk_many(index, index.withColumnRenamed("vacancy_id", "profile_id"), 3, 2, block_rows=8, few_queries=0)
    assert "Broadcast" not in frame._jdf.queryExecution().executedPlan().toString()
    assert frame.count() == 120


def test_odd_vectors_are_quarantined(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [])]
    index = spark.createDataFrame(rows, "vacancy_id bigint, embedding array<float>")
    good, bad = usable_vectors(index, 2)
    assert [r.vacancy_id for r in good.collect()] == [1]
    assert sorted(r.vacancy_id for r in bad.collect()) == [2, 3, 4, 5, 6]
    assert [r.vacancy_id for r in knn_topk(index, [1.0, 0.0], 5).collect()] == [1]


def test_hit_lists_are_bounded(spark):
    many = spark.range(101).select(F.col("id").alias("vacancy_id"))
    for refuse in (pin_hits, hit_ids):
        with pytest.raises(ValueError, match="at most 100"):
            refuse(many)


def test_k_is_bounded(spark):
    index = spark.createDataFrame([(1, "a", [1.0])], "vacancy_id bigint, source string, embedding array<float>")
    for k in (0, 101):
        with pytest.raises(ValueError, match="k must be"):
            knn_topk(index, [1.0], k)


RAW_09 = [0.8, 0.6]  # cosine 0.8 to (1, 0): raw score 0.9


def ask(spark, candidate, history, skills=(), **request):
    """Recommend one candidate (id 100) after a decision history."""
    stored = posting(spark, posting_row(100, **candidate), *[posting_row(i, **h) for i, (h, _) in enumerate(history)])
    decided = application(spark, *[(i, s) for i, (_, s) in enumerate(history)])
    index = spark.createDataFrame(
        [(100, "adzuna", RAW_09)], "vacancy_id bigint, source string, embedding array<float>")
    out = recommend(stored, decided, index, [1.0, 0.0], list(skills), Request(as_of=F.lit(NOW), **request))
    return [(r.vacancy_id, r.score) for r in out.collect()]


PLAIN = {"company": "Other", "description": "nothing", "title": "Dev"}
LIKED = [(PLAIN, "applied")] * 3


def test_score_with_one_skill(spark):
    history = [({**PLAIN, "description": "WordPress"}, "dismissed")] * 3 + LIKED
    assert ask(spark, {"description": "WordPress job"}, history, ["WordPress"]) == [(100, 80)]
    assert ask(spark, {"description": "other job"}, history, ["WordPress"]) == [(100, 90)]


def test_remote_and_seniority_stack_and_cap(spark):
    bad = {**PLAIN, "remote": True, "title": "Junior Dev", "description": "WordPress"}
    history = [(bad, "dismissed")] * 3 + LIKED
    candidate = {"remote": True, "title": "Junior PHP", "description": "WordPress"}
    assert ask(spark, candidate, history) == [(100, 70)]
    assert ask(spark, candidate, history, ["WordPress"]) == [(100, 70)]  # three signals, capped at 20


def test_filters_of_the_ranking(spark):
    assert ask(spark, {"last_seen_at": NOW - dt.timedelta(days=6)}, LIKED) == []
    assert ask(spark, {"last_seen_at": NOW - dt.timedelta(days=5)}, LIKED) == [(100, 90)]
    assert ask(spark, {"status": "removed"}, LIKED) == [(100, 90)]  # status alone hides nothing
    assert ask(spark, {"status": "removed"}, LIKED, freshness="status") == []
    assert ask(spark, {}, LIKED, min_score=91) == []
    assert ask(spark, {"company": "ACME"}, [({**PLAIN, "company": "acme "}, "dismissed")]) == []
    assert ask(spark, {"company": ""}, [({**PLAIN, "company": ""}, "dismissed")]) == [(100, 90)]


def test_hits_without_posting_or_with_a_verdict_vanish(spark):
    stored = posting(spark, posting_row(1), posting_row(2), posting_row(3))
    index = spark.createDataFrame(
        [(i, "adzuna", [1.0, i / 10]) for i in (1, 2, 3, 4)],
        "vacancy_id bigint, source string, embedding array<float>")
    decided = application(spark, (1, "dismissed"), (2, "saved"))
    out = recommend(stored, decided, index, [1.0, 0.0], [], Request(as_of=F.lit(NOW)))
    assert [(r.vacancy_id, r.application_status) for r in out.collect()] == [(2, "saved"), (3, None)]


def test_shortlist_and_rerank(spark):
    ranked = spark.createDataFrame(
        [(1, 90, 0.9), (2, 90, 0.91), (3, 80, 0.8), (4, 70, 0.7)], "vacancy_id bigint, score int, raw double")
    short = shortlist(ranked, 3)
    assert {r.vacancy_id: r.position for r in short.collect()} == {2: 1, 1: 2, 3: 3}
    ok = '{"is_error":false,"result":"{\\"score\\":%d}"}'
    responses = spark.createDataFrame(
        [(1, 0, False, ok % 50), (2, 0, False, "garbage"), (3, 0, False, ok % 95), (4, 0, False, ok % 99)],
        "vacancy_id bigint, returncode int, timed_out boolean, stdout string")
    assert [(r.vacancy_id, r.score) for r in rerank_with_scores(short, responses).collect()] == [(3, 95), (1, 50)]


@pytest.mark.parametrize("few", [50_000, 3])
def test_theta_join_by_tokens_equals_literal_search(spark, monkeypatch, few):
    """A vocabulary that is broadcast, and one that Bloom filters and a shuffle look for."""
    monkeypatch.setattr(fb, "FEW_WORDS", few)
    p, _ = texts(spark, [(1, "Go and rust, go!", None), (2, "golang RUST_c", None), (3, "ça c", None),
                         (4, "c++ and c#, php", None), (5, "c+++ xc++ c++x", None), (6, "ci/cd (.net) a.b", None),
                         (7, "we ++ it $1 \\\\d [x]", None)])
    words = ["go", "rust", "c", "absent", "c++", "c#", "php", "ci/cd", ".net", "++", "and rust", "$1",
             "\\\\d", "[x]", "a.b"]
    table = spark.createDataFrame([(w,) for w in words] + [("Go",), ("  ",), (None,)], "word string")
    a = sorted(fb.theta_join_words(p, words).collect())
    found = fb.theta_join_single_words(p, table)
    assert a == sorted(found.collect()) and len(a) > 3
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ("getbit" in plan) == (few == 3)


def test_feedback_deltas_beyond_a_constant(spark, monkeypatch):
    rows = [(i, f"c{i % 7}") for i in range(40)]
    categories = spark.createDataFrame(rows, "id bigint, category string")
    deltas = spark.createDataFrame([("c1", 10), ("c3", -10), ("c5", 5)], "category string, delta int")
    few = sorted(fb.join_feedback_delta(categories, deltas).collect())
    monkeypatch.setattr(fb, "MOST_CONSTANTS", 2)
    assert sorted(fb.join_feedback_delta(categories, deltas).collect()) == few
    assert sum(r.delta for r in few) == 6 * 10 - 6 * 10 + 5 * 5


def test_recommendation_properties(spark):
    """Hits only, ordered, adjusted within the cap - on the shared tables."""
    from postmill.bindings import load
    sf = "/root/testdata/sf0.001"
    queries, _ = load()
    rows = queries["recommend"](spark, sf).collect()
    from postmill.bindings.tables import index, profile_vector
    hits = {r.vacancy_id for r in knn_topk(index(spark, sf), profile_vector(spark, sf), 100).collect()}
    assert {r.vacancy_id for r in rows} <= hits
    assert [r.score for r in rows] == sorted((r.score for r in rows), reverse=True)
    assert all(-20 <= r.adjustment <= 20 and 40 <= r.score <= 100 for r in rows)
    assert all(r.application_status not in ("dismissed", "rejected") for r in rows)
