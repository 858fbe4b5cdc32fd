"""Text scalars as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FNV_OFFSET, FNV_PRIME = 2166136261, 16777619  # fixed values: 32-bit FNV-1a


def bare_tag(tag: Column) -> Column:
    """A tag without the suffix that counts a run of siblings."""
    return F.regexp_replace(tag, r"×\d+$", "")


def signature(tag: Column, classes: Column, text: Column) -> Column:
    """What a region keeps on other pages of its site: tag, first class, first 60 characters, case and blanks folded."""
    first = F.coalesce(F.get(F.split(F.coalesce(classes, F.lit("")), r"\s+"), F.lit(0)), F.lit(""))
    folded = F.left(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "), F.lit(60))
    return F.concat_ws("|", bare_tag(tag), first, folded)


def fnv1a(word: Column) -> Column:
    """32-bit FNV-1a over the code points of a word."""
    step = lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * FNV_PRIME).bitwiseAND(F.lit(4294967295))
    return F.when(word == "", F.lit(FNV_OFFSET)).otherwise(F.aggregate(F.split(word, ""), F.lit(FNV_OFFSET).cast("long"), step))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def text_stats(text: Column) -> dict[str, Column]:
    """words, commas (three scripts), sentences, lines, average line length, words in capitals, and log1p of the length."""
    trimmed = F.trim(F.coalesce(text, F.lit("")))
    lines = F.size(F.filter(F.split(trimmed, "\n"), lambda x: F.trim(x) != ""))
    return {
        "words": word_count(trimmed),
        "commas": F.regexp_count(trimmed, F.lit("[,،，]")),
        "sentences": F.regexp_count(trimmed, F.lit(r"[.!?](\s|\z)")),
        "lines": lines,
        "avg_line": F.when(lines > 0, F.length(trimmed) / lines).otherwise(0.0),
        "caps_words": F.regexp_count(trimmed, F.lit(r"(?<![A-Za-z0-9_])[A-Z]{3,}(?![A-Za-z0-9_])")),
        "log_length": F.log1p(F.length(trimmed)),
    }


def rank_quantile(values: Column, p: float) -> Column:
    """The value at rank floor(p n) of a group (the last one at most); exact, without interpolation. An aggregate for small groups."""
    held = F.array_sort(F.collect_list(values))
    n = F.size(held)
    return F.get(held, F.least(n - 1, F.floor(n * p).cast("int")))
