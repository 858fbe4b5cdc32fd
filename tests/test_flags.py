"""Flags against Python's reading of their patterns, and how often texts are looked at."""

import random
import re

from pyspark.sql import functions as F

from blockyard.functions.lexicon import ACTION, HINTS, TEXTS, bit_set, flag_columns, lowered, set_flags
from blockyard.plans.page_queries import flag_counts

PIECES = ["\r", "\n", " ", "  ", "-", "_", "é", "°c", "by ", "author", "-bio", "card", "__heading", "12", "/3", "points", "comments", ".", "★", "step 1", "noun", "cart", "share", "hinzufügen", "ok", "ad", "x", "vote", "12:30", "today"]


def held(pattern, text):
    return bool(re.search(re.sub(r"(?<!\\)\$", r"\\Z", lowered(pattern)), text, re.ASCII))


def some_texts():
    pick = random.Random(5)
    words = sorted({w for p in (*HINTS.values(), *TEXTS.values()) for w in re.findall(r"[a-z]{3,}", p)})
    return ["".join(pick.choice(PIECES) if pick.random() < 0.6 else pick.choice(words) + " " for _ in range(pick.randrange(1, 9))) for _ in range(3000)]


def test_flags_are_those_of_a_plain_reading(spark):
    texts = some_texts()
    rows = spark.createDataFrame([(t, t) for t in texts], "hint string, low string")
    told = rows.withColumns(flag_columns(F.col("hint"), F.col("low"))).withColumn("set", set_flags()).withColumn("act", bit_set(F.col("low"), [ACTION]))
    for r in told.collect():
        want = {f"h:{k}" for k, p in HINTS.items() if held(p, r["hint"])} | {f"x:{k}" for k, p in TEXTS.items() if held(p, r["low"])}
        assert set(r["set"]) == want, r["hint"]
        assert r["act"] == held(ACTION, r["low"])


def test_a_carriage_return_ends_no_line(spark):
    """As in the SQL, whose patterns are those of RE2."""
    row = spark.createDataFrame([("", "5 points by me today\r3 comments"), ("", None)], "hint string, low string").withColumns(flag_columns(F.col("hint"), F.col("low")))
    got = [set(r["set"]) for r in row.withColumn("set", set_flags()).collect()]
    assert "x:hnSubtext" in got[0] and got[1] == set()
    assert row.selectExpr("texts_0").collect()[1][0] == 0


def test_equal_names_are_looked_at_once_and_equal_flags_named_once(spark):
    rows = spark.createDataFrame([("author-bio", "", 2_000_000_000), ("author-bio", "", 2_000_000_000), ("byline", "by me", 1)], "hint string, low string, n int")
    assert {tuple(r) for r in flag_counts(rows).collect() if r["flag"] in ("h:authorBio", "h:byline", "x:byline")} == {("h:authorBio", 4_000_000_000), ("h:byline", 1), ("x:byline", 1)}
