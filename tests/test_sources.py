import json

from postmill.sources import feeds, normalize, pages, profile
from postmill.sources.tables import append, backfill, scan_posting, write_by_source
from pyspark.sql import functions as F


def write(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")
    return str(folder)


def test_json_pages(spark, tmp_path):
    page = {"results": [
        {"id": 1, "title": "PHP", "company": {"display_name": "Acme"}, "location": {"display_name": "Warsaw"},
         "redirect_url": "u", "description": "d", "category": {"label": "IT Jobs"}, "created": "2024-01-05T10:00:00Z",
         "salary_min": 10, "salary_max": 20.5, "salary_is_predicted": "1"},
        {"id": 2, "company": None},
    ]}
    path = write(tmp_path / "a", "p1.json", json.dumps(page, indent=1))
    write(tmp_path / "a", "p2.json", '{"results": []}')
    jobs = feeds.scan_json_jobs(feeds.read_json_pages(spark, path), F.lit("pl"))
    rows = {r.external_id: r for r in normalize.normalize_adzuna(jobs).collect()}
    first, second = rows["1"], rows["2"]
    assert (first.company, first.tags, first.salary_currency, first.salary_period, first.salary_is_predicted) == (
        "Acme", ["IT Jobs"], "PLN", "year", True)
    assert str(first.posted_at) == "2024-01-05 10:00:00" and first.salary_max == 20.5 and not first.remote
    assert (second.title, second.company, second.tags, second.salary_min, second.salary_is_predicted) == (
        "", "", [], None, False)


def test_tagged_pages(spark, tmp_path):
    def job(slug, **over):
        return {"slug": slug, "company_name": "C", "title": "Dev", "description": "&lt;p&gt;Hi&lt;/p&gt;", "remote": True,
                "url": "u", "tags": ["PHP"], "location": "Berlin", "created_at": 1704448800, **over}

    page = {"data": [job("a"), job("b", tags=[], description="java"), job("c", tags=None, created_at=0,
            title="php", description="&lt;b&gt;x&lt;/b&gt; Find Jobs in Germany on Arbeitnow")], "links": {"next": None}}
    path = write(tmp_path / "b", "p.json", json.dumps(page))
    raw = feeds.read_tagged_pages(spark, path)
    rows = {r.external_id: r for r in normalize.normalize_arbeitnow(feeds.scan_json_jobs_tagged(raw, ["php"])).collect()}
    assert set(rows) == {"a", "c"}
    assert rows["a"].description == "Hi" and str(rows["a"].posted_at) == "2024-01-05 10:00:00"
    assert (rows["c"].description, rows["c"].posted_at, rows["c"].tags) == ("x", None, [])
    assert feeds.scan_json_jobs_tagged(raw, []).count() == 0


RSS = """<?xml version="1.0"?><rss><channel><title>feed</title>
<item><title>R&amp;amp;D Dev в FAVBET, $2500–2700, Київ, віддалено</title>
<link>https://jobs.example.test/companies/x/vacancies/77/?utm=1&amp;a=2</link>
<description>&lt;p&gt;Uses Span&amp;lt;T&amp;gt;&lt;/p&gt;&lt;a&gt;Відгукнутись на вакансію&lt;/a&gt;</description>
<pubDate>Mon, 06 Jan 2025 10:00:00 +0200</pubDate></item>
<item><title>No link</title></item>
<item><title>No id</title><link>https://jobs.example.test/about/</link></item>
<item><title>Bad date в Y, до $900</title><link>https://jobs.example.test/vacancies/78/</link><pubDate>soon</pubDate></item>
</channel></rss>"""


def test_rss(spark, tmp_path):
    path = write(tmp_path / "rss", "feed.xml", RSS)
    jobs = feeds.scan_rss_items(feeds.read_rss(spark, path))
    rows = {r.external_id: r for r in normalize.normalize_dou(jobs).collect()}
    assert set(rows) == {"77", "78"}
    first = rows["77"]
    assert (first.title, first.company, first.location, first.remote) == ("R&D Dev", "FAVBET", "Київ", True)
    assert first.url == "https://jobs.example.test/companies/x/vacancies/77/"
    assert first.description == "Uses Span<T>" and first.salary_period == "month"
    assert str(first.posted_at) == "2025-01-06 08:00:00"
    assert (rows["78"].posted_at, rows["78"].salary_max, rows["78"].salary_period) == (None, 900.0, "month")


def test_sitemaps(spark, tmp_path):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    part = f"<urlset {ns}><url><loc>https://x/a</loc></url><url><loc>https://x/b?c=1&amp;d=2</loc></url></urlset>"
    path = write(tmp_path / "parts", "1.xml", part)
    assert sorted(r.loc for r in feeds.read_sitemap(spark, path).collect()) == ["https://x/a", "https://x/b?c=1&d=2"]
    index = spark.createDataFrame([(f"<sitemapindex {ns}><sitemap><loc>p1</loc></sitemap></sitemapindex>",)], "payload string")
    parts = spark.createDataFrame([("p1", part), ("p2", part.replace("x/", "y/"))], "part_url string, payload string")
    assert sorted(r.url for r in feeds.scan_sitemap_urls(index, parts).collect()) == ["https://x/a", "https://x/b?c=1&d=2"]


def test_listing_links(spark):
    def link(n):
        return f'<a href="/jobs/{n}-dev/">x</a><a href="/jobs/no-number/">y</a>'

    rows = spark.createDataFrame([
        ("c", 1, link(1) + link(2), 200, False), ("c", 2, link(2) + link(3), 200, False),
        ("c", 3, link(9), 200, True), ("c", 4, link(4), 200, False), ("d", 1, "nothing", 200, False), ("d", 2, link(5), 200, False),
        ("e", 1, link(6), 200, False), ("e", 2, link(7), 500, False),
    ], "crawl string, page int, html string, status int, was_redirected boolean")
    got = sorted((r.crawl, r.page, r.pos, r.url.split("/")[-2]) for r in pages.extract_listing_links(rows).collect())
    assert got == [("c", 1, 0, "1-dev"), ("c", 1, 1, "2-dev"), ("c", 2, 1, "3-dev"), ("e", 1, 0, "6-dev")]


def page(*blocks):
    return "<html>" + "".join(f'<script id="x" type="application/ld+json">{b}</script>' for b in blocks) + "</html>"


JOB = {
    "@type": "JobPosting", "title": "Dev", "hiringOrganization": {"name": "Org"}, "description": "d",
    "jobLocation": {"address": {"addressLocality": ["Kyiv", "Lviv"], "addressCountry": "UA"}},
    "jobLocationType": "TELECOMMUTE", "datePosted": "2024-01-05", "url": "https://djinni.co/jobs/55-dev/",
    "baseSalary": {"currency": "USD", "value": {"minValue": 1000, "maxValue": 2000, "unitText": "MONTH"}},
}


def test_jsonld(spark):
    bare = {"@type": "JobPosting", "jobLocation": None, "baseSalary": None, "hiringOrganization": None}
    crumb = '{"@type": "BreadcrumbList", "title": "crumb"}'
    rows = spark.createDataFrame([
        ("https://djinni.co/jobs/1-a/", page(crumb, json.dumps(JOB)), 200), ("https://djinni.co/jobs/2-b/", page(json.dumps(bare)), 200),
        ("https://djinni.co/jobs/3-c/", page("{broken", json.dumps(JOB)), 200), ("https://djinni.co/jobs/4-d/", page(crumb), 200),
        ("https://djinni.co/jobs/5-e/", "no block", 200), ("https://djinni.co/jobs/6-f/", page(json.dumps(JOB)), 404),
        ("https://djinni.co/jobs/7-g/", page(json.dumps({**JOB, "datePosted": "soon", "url": None})), 200),
    ], "url string, html string, status int")
    jobs, bad = pages.jobposting_to_job(pages.extract_jsonld(rows))
    got = {r.external_id: r for r in jobs.collect()}
    assert set(got) == {"55", "2"}
    full = got["55"]
    assert (full.location, full.remote, full.salary_min, full.salary_currency, full.salary_period) == (
        "Kyiv, Lviv, UA", True, 1000.0, "USD", "month")
    assert str(full.created_at) == "2024-01-05 00:00:00"
    empty = got["2"]
    assert (empty.title, empty.company, empty.location, empty.remote, empty.salary_min, empty.salary_period) == (
        "", "", "", False, None, "")
    assert [r.url for r in bad.collect()] == ["https://djinni.co/jobs/7-g/"]
    other = pages.extract_jsonld(rows, fall_back_to_first=True)
    from_page, _ = pages.jobposting_to_job(other, id_from_block_url=False)
    assert {r.external_id: r.title for r in from_page.collect()} == {"1-a": "Dev", "2-b": "", "4-d": "crumb"}


def test_registry_and_fetch_all(spark):
    def reader(rows):
        return lambda: spark.createDataFrame(rows, "external_id string, title string, ordinal bigint")

    def shape(name):
        return lambda jobs: normalize.to_batch(jobs, name, company=F.lit("C"), url=F.lit("u"))

    assert set(normalize.NORMALIZERS) == {"adzuna", "arbeitnow", "justjoinit", "dou", "djinni"}
    normalize.register_source("one", reader([("a", "first", 0), ("a", "second", 1), ("b", "x", 2)]), shape("one"))
    try:
        rows = normalize.fetch("one")
        assert rows.columns[:2] == ["source", "external_id"] and rows.count() == 3
        again = rows.withColumn("title", F.lit("late")).withColumn("ordinal", F.lit(0))
        first = shape("one")(reader([("a", "first", 0), ("a", "second", 1), ("b", "x", 2)])())
        first = first.withColumn("ordinal", F.when(F.col("title") == "first", 0).otherwise(1))
        got = {r.external_id: r.title for r in normalize.fetch_all([first, again]).collect()}
        assert got == {"a": "first", "b": "x"}
    finally:
        normalize.NORMALIZERS.pop("one")


PROFILE = {
    "full_name": "Ann", "summary": "s", "skills": [{"name": "PHP", "category": "language"}],
    "experiences": [{"title": "Dev", "company": "X", "start_date": "2020-01-01", "end_date": None, "highlights": "a\n\nb"}],
}


def test_profile_file(spark, tmp_path):
    path = write(tmp_path / "prof", "p.json", json.dumps(PROFILE, indent=2))
    good, bad = profile.scan_profile(profile.read_profiles(spark, path), F.lit(1))
    row = good.first()
    assert (row.id, row.full_name, row.email, row.educations) == (1, "Ann", "", [])
    assert str(row.experiences[0].start_date) == "2020-01-01" and row.experiences[0].end_date is None
    assert bad.count() == 0
    broken = {**PROFILE, "experiences": [{"title": "Dev", "start_date": "2020-13-01"}]}
    path = write(tmp_path / "prof2", "p.json", json.dumps(broken))
    good2, bad2 = profile.scan_profile(profile.read_profiles(spark, path), F.lit(1))
    assert (good2.count(), bad2.count()) == (0, 1)
    fresh = good.withColumn("summary", F.lit("new")).withColumn("skills", F.slice("skills", 1, 0))
    replaced = profile.replace_profile(good, fresh).collect()
    assert [(r.id, r.summary, r.skills) for r in replaced] == [(1, "new", [])]
    version = profile.append_resume_version(good, "v1", F.current_timestamp()).first()
    assert json.loads(version.content)["skills"][0]["name"] == "PHP" and version.label == "v1"


def test_stored_posting_gets_defaults_for_old_files(spark, tmp_path):
    path = str(tmp_path / "old")
    append(spark.createDataFrame([(1, "adzuna", "a", "T")], "id bigint, source string, external_id string, title string"), path)
    row = scan_posting(spark, path).first()
    assert (row.status, row.missed_run_count, row.title) == ("active", 0, "T")
    assert [r.vacancy_id for r in backfill(scan_posting(spark, path), F.current_timestamp()).collect()] == [1]


def test_source_filter_prunes_folders(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = spark.createDataFrame([(i, "abc"[i % 3], [1.0]) for i in range(9)], "vacancy_id bigint, source string, embedding array<float>")
    write_by_source(rows, path)
    from postmill.operators.filters import filter_sources
    kept = filter_sources(spark.read.parquet(path), ["a", "c"])
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [source" in plan and kept.count() == 6
