"""Glob patterns and redirect templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_to_regex(pattern: Column) -> Column:
    """Anchored, case-insensitive Java regex: * is any text, ? one character, <all_urls> everything; each wildcard is a group."""
    quoted = F.regexp_replace(pattern, r"([.+^${}()|\[\]\\])", r"\\$1")
    body = F.regexp_replace(F.regexp_replace(quoted, r"\*", "(.*)"), r"(?<!\\)\?", "(.)")
    return F.when(pattern == "<all_urls>", F.lit("(?is)^(.*)\\z")).otherwise(F.concat(F.lit("(?is)^"), body, F.lit("\\z")))


def fill_template(template: Column, subject: Column, regex: Column) -> Column:
    """``template`` with $0..$9 replaced by the groups of ``regex`` in ``subject``; a group that isn't there is empty."""
    groups = F.size(F.regexp_extract_all(regex, F.lit(r"(?<!\\)\((?!\?)"), F.lit(0)))
    out = template
    for i in range(10):
        value = F.when(groups >= i, F.call_function("regexp_extract", subject, regex, F.least(F.lit(i), groups))).otherwise("")
        out = F.replace(out, F.lit(f"${i}"), value)
    return out
