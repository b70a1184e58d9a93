"""Per-board rows to the one posting schema, and their union."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import html_to_text
from ..functions.text import strip_footer_fixed, strip_footer_multi
from ..functions.values import epoch_to_ts
from ..operators.ordered import keep_first
from ..schemas import BATCH


def to_batch(jobs: DataFrame, source: str, **columns: Column) -> DataFrame:
    """Select the shared schema. ``columns`` override; absent ones get their default."""
    defaults = {
        "source": F.lit(source), "location": F.lit(""), "remote": F.lit(False),
        "description": F.lit(""), "tags": F.array().cast("array<string>"),
        "posted_at": F.lit(None), "salary_min": F.lit(None), "salary_max": F.lit(None),
        "salary_currency": F.lit(""), "salary_period": F.lit(""),
        "salary_is_predicted": F.lit(False),
    }
    have = {c: F.col(c) for c in jobs.columns}
    chosen = {**defaults, **have, **columns, "source": F.lit(source)}
    return jobs.select(*[chosen[name].cast(kind).alias(name) for name, kind in BATCH.items()])


def normalize_adzuna(jobs: DataFrame) -> DataFrame:
    """The API does not tell remote from on site; its category is the only tag."""
    tags = F.filter(F.array("category"), lambda c: c != "")
    return to_batch(jobs, "adzuna", remote=F.lit(False), tags=tags, posted_at=F.col("created_at"))


def normalize_arbeitnow(jobs: DataFrame) -> DataFrame:
    """Entity-escaped markup and a platform footer to strip."""
    return to_batch(
        jobs, "arbeitnow",
        description=strip_footer_multi(html_to_text(F.col("description"))),
        posted_at=epoch_to_ts(F.col("created_epoch")))


def normalize_dou(jobs: DataFrame) -> DataFrame:
    """Real markup (already unescaped by the XML layer); salaries are monthly."""
    paid = F.col("salary_min").isNotNull() | F.col("salary_max").isNotNull()
    return to_batch(
        jobs, "dou",
        description=strip_footer_fixed(html_to_text(F.col("description"), unescape_first=False)),
        posted_at=epoch_to_ts(F.col("created_epoch")),
        salary_period=F.when(paid, F.lit("month")).otherwise(F.lit("")))


def normalize_djinni(jobs: DataFrame) -> DataFrame:
    return to_batch(jobs, "djinni", posted_at=F.col("created_at"))


def normalize_justjoinit(jobs: DataFrame) -> DataFrame:
    return to_batch(jobs, "justjoinit", posted_at=F.col("created_at"))


#: name -> normaliser of that board's job rows.
NORMALIZERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "adzuna": normalize_adzuna,
    "arbeitnow": normalize_arbeitnow,
    "justjoinit": normalize_justjoinit,
    "dou": normalize_dou,
    "djinni": normalize_djinni,
}
_READERS: dict[str, Callable[..., DataFrame]] = {}


def register_source(
    name: str, read: Callable[..., DataFrame], normalize: Callable[[DataFrame], DataFrame],
) -> None:
    """Add a board: ``read(...)`` gives its job rows, ``normalize`` the shared schema."""
    _READERS[name] = read
    NORMALIZERS[name] = normalize


def fetch(name: str, *args, **kwargs) -> DataFrame:
    """Rows of one registered board in the shared schema."""
    return NORMALIZERS[name](_READERS[name](*args, **kwargs))


def union_sources(batches: Sequence[DataFrame]) -> DataFrame:
    """Bag union in the given order; ``_batch`` remembers which input a row came from."""
    return reduce(
        DataFrame.unionByName,
        [b.withColumn("_batch", F.lit(i).cast("bigint")) for i, b in enumerate(batches)])


def fetch_all(batches: Sequence[DataFrame]) -> DataFrame:
    """Union of all sources, first occurrence per ``(source, external_id)``.

    Batches need an ``ordinal`` (row order inside the batch); earlier batches win.
    """
    rows = union_sources(batches).withColumn("_order", F.struct("_batch", "ordinal"))
    return keep_first(rows, ["source", "external_id"], "_order").drop("_order", "_batch")
