"""Which of many texts match which of many patterns, without comparing every text with every pattern.

A pattern can only match texts that hold its literal pieces. Each pattern waits under one key that such a text must have:
the one of its whole words, else of its three, two or one characters, that fewest texts have, by a count over all texts.
Texts meet patterns by an equality join on keys, and the pattern's regular expression has the last word. Keys that many
texts share are salted on both sides, so that no key fills a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = "a-z0-9%"
GAP = "\x01"  # stands for text that the pattern leaves open
EDGE = "\x02"  # stands for one character that is in no word, or the end


def folded(text: Column) -> Column:
    """ASCII lower case, as patterns disregard it."""
    return F.translate(text, UPPER, LOWER)


def grams(piece: Column, n: int) -> Column:
    """All runs of n characters of a text, each once."""
    spots = F.when(F.length(piece) >= n, F.sequence(F.lit(1), F.length(piece) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(spots, lambda i: F.substr(piece, i, F.lit(n))))


def glob_shape(pattern: Column) -> Column:
    """The literal text of an anchored glob; what it leaves open are gaps."""
    return F.when(pattern == "<all_urls>", F.lit(GAP)).otherwise(F.regexp_replace(folded(pattern), "[*?]", GAP))


def _grams_of(n: int):
    return lambda piece: grams(piece, n)


def _named(kind: str, keys: Column) -> Column:
    return F.transform(keys, lambda k: F.concat(F.lit(kind), k))


def shape_keys(shape: Column) -> Column:
    """Keys that a text must have to match: whole words, else runs of 3, 2 or 1 characters; one empty key if nothing is fixed."""
    words = F.array_distinct(F.regexp_extract_all(shape, F.lit(f"(?<![{WORD}{GAP}])[{WORD}]{{3,}}(?![{WORD}{GAP}])"), F.lit(0)))
    pieces = F.filter(F.split(shape, f"[{GAP}{EDGE}]"), lambda p: p != "")
    out = F.when(F.size(words) > 0, _named("w", words))
    for n in (3, 2, 1):
        own = F.array_distinct(F.flatten(F.transform(pieces, _grams_of(n))))
        out = out.when(F.size(own) > 0, _named(str(n), own))
    return out.otherwise(F.array(F.lit("")))


def text_keys(text: Column, kinds: set[str]) -> Column:
    """The keys of those kinds that a text has."""
    low = folded(text)
    parts = [F.array(F.lit(""))] if "" in kinds else []
    if "w" in kinds:
        parts.append(_named("w", F.array_distinct(F.regexp_extract_all(low, F.lit(f"[{WORD}]{{3,}}"), F.lit(0)))))
    parts += [_named(str(n), grams(low, n)) for n in (3, 2, 1) if str(n) in kinds]
    return F.concat(*parts) if parts else F.array().cast("array<string>")


def matching_pairs(texts: DataFrame, patterns: DataFrame, text: str, regex: str = "regex", shape: str = "shape", per_task: int = 50_000) -> DataFrame:
    """The rows of ``texts`` with every row of ``patterns`` that matches them: all columns of both but ``shape``.

    ``shape`` is the pattern's literal text with gaps; the names of both tables must differ. Null texts and patterns match
    nothing. Patterns without any literal text meet all texts, as they must, spread over tasks of ``per_task`` texts.
    """
    held = [c for c in patterns.columns if c != shape]
    coded = patterns.filter(F.col(regex).isNotNull()).withColumns({"_pid": F.xxhash64(*patterns.columns), "_keys": shape_keys(F.col(shape))}).dropDuplicates(["_pid"])
    # Written, so that small tables of patterns are known to be small, and go to the texts instead of shuffling these.
    coded = materialise(coded.drop(shape), "patterns")
    keys = coded.select("_pid", F.explode("_keys").alias("_key"))
    kinds = {r[0] for r in keys.select(F.substring("_key", 1, 1)).distinct().collect()}  # five at most
    each = texts.filter(F.col(text).isNotNull()).withColumn("_key", F.explode(text_keys(F.col(text), kinds)))
    known = each.select("_key").join(keys.select("_key").distinct(), "_key", "left_semi").groupBy("_key").agg(F.count("*").alias("_n"))
    chosen = keys.join(known, "_key").groupBy("_pid").agg(F.min(F.struct("_n", "_key")).alias("_c")).select("_pid", F.col("_c._key").alias("_key"), (1 + F.floor(F.col("_c._n") / per_task)).cast("int").alias("_salts"))
    # Keys of very many texts are few: no more than keys of a text times texts, over per_task.
    waiting = materialise(coded.join(chosen, "_pid").select("_key", "_salts", *held), "patterns")
    hot = F.broadcast(waiting.filter("_salts > 1").select("_key", "_salts").distinct())
    dealt = each.join(hot, "_key", "left").withColumn("_salt", F.pmod(F.xxhash64(*texts.columns), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    waiting = waiting.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).select("_key", "_salt", *held)
    return dealt.join(waiting, ["_key", "_salt"]).filter(F.expr(f"`{text}` rlike `{regex}`")).drop("_key", "_salt")
