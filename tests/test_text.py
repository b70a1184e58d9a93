import time
from html import unescape

import pytest
from postmill.constants import SENIORITY_LEVELS
from postmill.functions import html as H
from postmill.functions import text as T
from postmill.functions import urls as U
from postmill.functions import values as V
from postmill.functions.packed_title import parse_packed_title, parse_salary_text
from postmill.functions.verdict import parse_verdict, profile_query_text, scoring_prompt
from pyspark.sql import functions as F

MARKUP = {
    "<p>Hello</p><p>World</p>": "Hello World",
    "visible &amp": "visible &",
    "<td>Python</td><td>Django</td>": "Python Django",
    "<style>a{}</style>b<script>var x='<p>';</script><p title=\"a>b\">d</p>": "b d",
    "a<!-- <p>hidden</p> -->b": "ab",
    "<head><title>T</title></head><header>shown</header>": "shown",
    "<template><p>no</p></template>yes": "yes",
    "x &lt;T&gt; &#39;q&#x27; &eacute; &notit; &#128512; &amp;lt; &bogus; &nbsp; end":
        "x <T> 'q' é ¬it; 😀 &lt; &bogus; end",
    "line\n\n\tbreak  <br/>next": "line break next",
    "<script>var a=1;</script >tail <DIV class='a'>Up</DIV>": "tail Up",
    "no markup at all": "no markup at all",
    "": "",
    "<p title=\"a\"b\">x</p><p class=\"x\">word</p>": "x word",
    "<template>a<template>b</template>c</template>d": "d",
    "<template/>shown<script/>too": "showntoo",
    "<template>a</script>b</template>c": "bc",
    "a<!-- b <p>c": "a",
    "a<script>b<p>c": "a",
    "a< b>c <1>d </1>e </>f": "a< b>c <1>d e f",
    "a<?x y>b<!DOCTYPE z>c": "abc",
    "a &am<b>p; b": "a &amp; b",
    "<p x='>'>b<p =\"y\">c": "b c",
    "&#128; &#x1; &#xD800; &#99999999999999; &#x110000; &#0;": "€ \ufffd \ufffd \ufffd \ufffd",
}


def test_visible_text(values):
    assert values("string", list(MARKUP), lambda c: H.html_to_text(c, False)) == list(
        MARKUP.values())


@pytest.mark.parametrize(("markup", "expected"), [
    ('<p title="a"b">x</p>' * 100_000, " ".join(["x"] * 100_000)),
    ("<template>" * 2000 + "a" + "</template>" * 2000 + "b", "b"),
    ("<template>a</template>b " * 5000, " ".join(["b"] * 5000)),
    ("a" + "<!-- b " * 20_000, "a"),
    ("".join(f"&#{n};" for n in range(0x4E00, 0x4E00 + 4000)),
     "".join(map(chr, range(0x4E00, 0x4E00 + 4000)))),
    ("<p " + " ".join(f"a{n}='{n}'" for n in range(20_000)) + ">x", "x"),
], ids=["stray quotes", "nested", "many hidden", "open comments", "references", "attributes"])
def test_hard_markup_takes_time_in_proportion(values, markup, expected):
    start = time.monotonic()
    assert values("string", [markup], lambda c: H.html_to_text(c, False)) == [expected]
    assert time.monotonic() - start < 30


def test_html_escaped_payload(values):
    raw = ["&lt;p&gt;Hello&lt;/p&gt;&lt;p&gt;World&lt;/p&gt;", None]
    assert values("string", raw, H.html_to_text) == ["Hello World", None]
    assert values("string", ["Span&lt;T&gt;"], lambda c: H.html_to_text(c, False)) == ["Span<T>"]


def test_unescape_matches_standard_library(values):
    raw = ["&lt&lt;&ltx", "&amp;amp;", "&#38;lt;", "&#x26;#60;", "&copy2024 &copy;", "&NotEqualTilde;",
           "100&percnt;", "&#0;", "&#150;", "&#x0000026;", "&;", "&#;", "R&amp;D", "a & b &", "&#128512;&#x1F600;", "&lang;&rang;", "&am"]
    assert values("string", raw, H.unescape_entities) == [unescape(r) for r in raw]


@pytest.mark.parametrize(("text", "word", "found"), [
    ("good", "go", False), ("i know go.", "go", True), ("golang", "go", False), ("go_lang", "go", True),
    ("c++ developer", "c++", True), ("use c#/.net", "c#", True), ("use c#/.net", ".net", True),
    ("career", "r", False), ("ça va", "a", False), ("(r)", "r", True), ("go go", "go", True),
])
def test_word_mentioned(values, text, word, found):
    assert values("string", [text], lambda c: T.word_mentioned(c, word)) == [found]


def test_repeated_skill_counts_twice(values):
    words = T.clean_words([" Go ", "go", "", "Rust"])
    assert values("string", ["go and rust"], lambda c: F.array_compact(T.word_marks(c, words))) == [["go", "go", "rust"]]


def test_primary_seniority(values):
    titles = ["Senior Lead Engineer", "Lead Senior", "Midwife", "Middle dev", "Head of Staff", "none",
              "internal intern"]
    got = values("string", titles, lambda c: T.primary_seniority(F.lower(c), SENIORITY_LEVELS))
    # 'middle' and 'mid' share position 1, but only 'middle' is a whole word
    assert got == ["senior", "lead", None, "middle", "head", None, "intern"]


def test_reorder_description(values):
    texts = [
        "About us. Requirements: x", "prerequirements only", "see requirements.txt. Your profile: a",
        "Requirements first", "😀 boiler WymaganiaBackend and requirements", "O firmie. Wymagania: PHP", None,
    ]
    assert values("string", texts, T.reorder_description) == [
        "Requirements: x About us. ", "prerequirements only", "Your profile: a see requirements.txt. ",
        "Requirements first", "WymaganiaBackend and requirements 😀 boiler ", "Wymagania: PHP O firmie. ", None]


def test_norm_company(values):
    assert values("string", [" ACME ", "Straße", "\t x", "  "], T.norm_company) == [
        "acme", "strasse", "x", ""]


def test_footers(values):
    assert values("string", [
        "Text. Find Jobs in Germany on Arbeitnow", "Find Jobs in Germany on Arbeitnow is a phrase",
        "Text Find more English Speaking Jobs in United Kingdom on Arbeitnow. "], T.strip_footer_multi) == [
        "Text.", "Find Jobs in Germany on Arbeitnow is a phrase", "Text"]
    assert values("string", ["Текст Відгукнутись на вакансію"], T.strip_footer_fixed) == ["Текст"]


def test_packed_title(values):
    rows = values("string", [
        "Senior PHP Developer в FAVBET, Київ, за кордоном, віддалено",
        "Treasury Specialist в Glovo в Glovo, Київ", "Dev в X, $2500–2700", "Dev в X, $3000-1000, Lviv",
        "Dev в X, від $1800", "Dev в X, до $2500", "Dev в X, $700", "Just a title", "Dev в , ,",
    ], parse_packed_title)
    assert rows[0][:4] == ("Senior PHP Developer", "FAVBET", "Київ, за кордоном", True)
    assert rows[1][:3] == ("Treasury Specialist в Glovo", "Glovo", "Київ")
    assert rows[2][4:] == (2500.0, 2700.0, "USD")
    assert rows[3][2:] == ("Lviv", False, 1000.0, 3000.0, "USD")
    assert rows[4][4:] == (1800.0, None, "USD")
    assert rows[5][4:] == (None, 2500.0, "USD")
    assert rows[6][4:] == (700.0, 700.0, "USD")
    assert rows[7] == ("Just a title", "", "", False, None, None, "")
    assert rows[8][:2] == ("Dev", "")


def test_salary_text_is_null_for_other_text(values):
    assert values("string", ["Київ", "$", "$1,500", "$5x"], parse_salary_text) == [
        None, None, (1500.0, 1500.0), None]


def test_dates(values):
    assert values("string", [
        "Mon, 06 Jan 2025 10:00:00 +0200", "6 Jan 25 10:00 GMT", "Tue, 07 Jan 2025 10:00:00 EST",
        "rubbish", None, "99 Jan 2025 10:00:00 +0000"], V.rfc2822_to_epoch) == [
        1736150400, 1736157600, 1736262000, None, None, None]
    days = values("string", ["2024-02-29", "2023-02-29", "29.02.2024", None], V.iso_date)
    assert [str(d) for d in days] == ["2024-02-29", "None", "None", "None"]
    assert values("date", [None], V.month_label) == ["Present"]


def test_money(spark):
    rows = spark.createDataFrame([
        (60000.0, 96000.0, "year"), (50.0, 80.0, "hour"), (5000.0, 8000.0, "month"), (1.0, 2.0, ""),
        (None, 2.0, "year"), (1.0, None, "month"),
    ], "a double, b double, p string")
    got = [tuple(r.m) if r.m else None for r in rows.select(
        V.monthly_salary(F.col("a"), F.col("b"), F.col("p")).alias("m")).collect()]
    assert got == [(5000.0, 8000.0), (5775.0, 9240.0), (5000.0, 8000.0), (1.0, 2.0), None, None]
    label = rows.select(V.salary_label(
        F.col("a"), F.col("b"), F.lit("PLN"), F.col("p"), F.col("p") == "year").alias("s")).collect()
    assert [r.s for r in label] == [
        "60,000–96,000 PLN/year (estimated)", "50–80 PLN/hour", "5,000–8,000 PLN/month", "1–2 PLN",
        "up to 2 PLN/year (estimated)", "from 1 PLN/month"]


def test_display_score_rounds_half_even(values):
    assert values("double", [0.125, 0.135, 0.005, 0.9, 1.2, -0.5], lambda c: V.display_score(c, F.lit(0))) == [
        round(12.5), round(0.135 * 100), 0, 90, 100, 0]


def test_urls(values):
    assert values("string", [
        "https://www.arbeitnow.com/api?page=2", "http://www.arbeitnow.com/x", "https://evil.test/",
        "https://www.arbeitnow.com.evil.test/", "https://user@www.arbeitnow.com:443/x", None,
    ], U.host_and_scheme_allowed) == [True, False, False, False, True, False]
    assert values("string", ["https://a/b?app_id=1&app_key=2#f"], U.redact_url) == [
        "https://a/b?app_id=***&app_key=***#f"]
    assert values("string", ["https://a/b/c/", "https://a/b"], U.last_segment) == ["c", "b"]


def test_tags(values):
    assert values("string", ["a,,b", "", "x"], V.tags_split) == [["a", "b"], [], ["x"]]


def test_verdicts(spark):
    def envelope(result):
        return '{"is_error":false,"result":%s}' % result

    cases = [
        (0, False, envelope('"{\\"score\\":85,\\"reasoning\\":\\"good fit\\",\\"concerns\\":[]}"'), "success", 85),
        (0, False, envelope('"```json\\n{\\"score\\": 7}\\n```"'), "success", 7),
        (0, False, envelope('"{}"'), "success", 0),
        (0, False, envelope('"{\\"score\\":7.9}"'), "success", 7),
        (0, False, envelope('"{\\"score\\":\\"7.5\\"}"'), "parse_error", None),
        (0, False, envelope('"{\\"score\\":null}"'), "parse_error", None),
        (0, False, envelope('"no json"'), "parse_error", None),
        (0, False, '{"is_error":false}', "parse_error", None),
        (0, False, '{"is_error":true,"result":"x"}', "api_error", None),
        (0, False, "plain text", "bad_stdout", None),
        (1, False, envelope('"{}"'), "nonzero_exit", None),
        (0, True, None, "timeout", None),
    ]
    frame = spark.createDataFrame(
        [(i, *c[:3]) for i, c in enumerate(cases)], "i int, rc int, late boolean, out string")
    got = frame.select("i", parse_verdict(F.col("rc"), F.col("late"), F.col("out")).alias("v")).orderBy("i").collect()
    assert [(r.v.outcome, r.v.score) for r in got] == [c[3:] for c in cases]
    assert got[0].v.reasoning == "good fit" and got[0].v.concerns == []


def test_prompts(spark):
    row = spark.sql("""select named_struct('title','T','company','C','location','L','remote',true,
        'description', repeat('d', 4000)) as p, named_struct('summary','S',
        'skills', array(named_struct('name','a','category',''), named_struct('name','b','category','')),
        'experiences', array(named_struct('title','Dev','company','X','location','',
            'start_date', date'2020-01-01', 'end_date', cast(null as date), 'highlights','h'))) as f""")
    got = row.select(scoring_prompt(F.col("p"), F.col("f")).alias("a"), profile_query_text(F.col("f")).alias("b")).first()
    assert "- Dev at X (2020-01-01–present): h" in got.a and "(remote=True)" in got.a
    assert "d" * 3000 in got.a and "d" * 3001 not in got.a
    assert got.b == "query: S\nSkills: a, b\nDev at X: h"
