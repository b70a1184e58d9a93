"""URL helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import NEXT_PAGE_HOST


def without_query(url: Column) -> Column:
    return F.substring_index(url, "?", 1)


def last_segment(url: Column) -> Column:
    """Text behind the last slash, trailing slashes ignored."""
    return F.substring_index(F.regexp_replace(url, r"/+\z", ""), "/", -1)


def id_in_url(url: Column, pattern: str) -> Column:
    """Group 1 of ``pattern`` in ``url``, NULL when it does not occur."""
    return F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))


def host_and_scheme_allowed(url: Column, host: str = NEXT_PAGE_HOST) -> Column:
    """True for an https URL on exactly the allowed host."""
    scheme = F.lower(F.regexp_extract(url, r"\A([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    authority = F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    name = F.lower(F.regexp_replace(F.substring_index(authority, "@", -1), r":[0-9]*\z", ""))
    return F.coalesce((scheme == "https") & (name == host.lower()), F.lit(False))


def url_host(url: Column) -> Column:
    authority = F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.substring_index(authority, "@", -1), r":[0-9]*\z", ""))


def redact_url(url: Column, names: tuple[str, ...] = ("app_id", "app_key")) -> Column:
    """Mask the values of credential parameters."""
    return F.regexp_replace(url, rf"([?&](?:{'|'.join(names)})=)[^&#]*", "$1***")
