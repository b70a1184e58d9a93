"""Every board from landed files to its stored table, through the registry."""

import datetime as dt
import json

import pytest
from helpers import NOW
from postmill.plans.ingest import current_posting, runs
from postmill.session import shared_dir
from postmill.sources import normalize
from postmill.sources.boards import PAGE, ingest_board
from pyspark.sql import functions as F
from test_sources import JOB, RSS, page, write


@pytest.fixture
def landing(spark, tmp_path):
    search = {"results": [{"id": 1, "title": "PHP", "company": {"display_name": "Acme"}, "salary_min": 10}]}
    tagged = {"data": [{"slug": "a", "company_name": "C", "title": "PHP dev", "url": "u", "tags": ["PHP"]},
                       {"slug": "b", "company_name": "C", "title": "Java dev", "url": "u", "tags": []}]}
    write(tmp_path / "adzuna", "p.json", json.dumps(search))
    write(tmp_path / "arbeitnow", "p.json", json.dumps(tagged))
    write(tmp_path / "dou", "feed.xml", RSS)
    for board, urls in (("djinni", ["https://djinni.co/jobs/55-dev/", "https://djinni.co/jobs/6-f/"]),
                        ("justjoinit", ["https://x.test/acme-php-dev", "https://x.test/acme-java-dev"])):
        rows = [(u, page(json.dumps(JOB)), 404 if "6-f" in u else 200) for u in urls]
        spark.createDataFrame(rows, PAGE).write.parquet(str(tmp_path / board))
    return str(tmp_path)


def test_five_boards_from_landed_files(spark, landing):
    root = shared_dir(spark, "store")
    at = F.lit(NOW)
    counts = {name: ingest_board(spark, root, n, name, landing, at, ["php"], "pl")["new_count"]
              for n, name in enumerate(normalize.NORMALIZERS, 1)}
    assert counts == {"adzuna": 1, "arbeitnow": 1, "justjoinit": 1, "dou": 2, "djinni": 1}
    rows = {(r.source, r.external_id): r for r in current_posting(spark, root).collect()}
    assert set(rows) == {("adzuna", "1"), ("arbeitnow", "a"), ("justjoinit", "acme-php-dev"), ("dou", "77"),
                         ("dou", "78"), ("djinni", "55")}
    assert rows["adzuna", "1"].salary_currency == "PLN" and rows["djinni", "55"].salary_period == "month"
    assert rows["dou", "77"].description == "Uses Span<T>"
    # A second run of a board whose files are gone from the landing is a failed run.
    again = ingest_board(spark, root, 9, "dou", landing, F.lit(NOW + dt.timedelta(hours=1)))
    assert (again["new_count"], again["updated_count"], again["to_embed_count"]) == (0, 2, 0)
    with pytest.raises(Exception, match="[Pp]ath"):
        ingest_board(spark, root, 10, "dou", f"{landing}/nowhere", at)
    assert {r.run_id: r.state for r in runs(spark, root).collect()}[10] == "failed"
    assert current_posting(spark, root, "dou").count() == 2


def test_unknown_board(spark):
    with pytest.raises(KeyError):
        normalize.fetch("nowhere", spark, "/tmp", [], "")
