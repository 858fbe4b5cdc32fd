"""URL scalars as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def host(url: Column) -> Column:
    """Lower-case host with port, without user info and without a leading www.; null where there is none."""
    raw = F.regexp_extract(url, _AUTHORITY, 1)
    bare = F.regexp_replace(F.lower(F.regexp_replace(raw, r"^[^@]*@", "")), r"^www\.", "")
    return F.when(bare != "", bare)


def path(url: Column) -> Column:
    """Path of an absolute URL; '/' where it is empty."""
    raw = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(raw == "", "/").otherwise(raw)


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def url_key(url: Column) -> Column:
    """Origin and path: what tells two pages apart when query and hash do not count."""
    return F.concat(origin(url), path(url))


def path_depth(url: Column) -> Column:
    """Parts of the path that are not empty."""
    return F.size(F.filter(F.split(path(url), "/"), lambda p: p != ""))


def parent_host(name: Column) -> Column:
    """The host without its first label; null for a single label."""
    return F.when(name.contains("."), F.regexp_replace(name, r"^[^.]*\.", ""))


def host_suffixes(name: Column) -> Column:
    """The host and all its parents, longest first."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def slug(name: Column) -> Column:
    """Runs of other characters than letters and digits become one dash; none at either end."""
    return F.regexp_replace(F.regexp_replace(name, r"(?i)[^a-z0-9]+", "-"), r"^-|-$", "")


def is_page_url(url: Column) -> Column:
    """An http(s) URL whose path isn't a PDF."""
    return url.rlike(r"(?i)^https?://") & ~path(url).rlike(r"(?i)\.pdf$")
