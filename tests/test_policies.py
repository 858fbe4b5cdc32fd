"""Label policies and lists of types that a user names, replaces or leaves out."""

import pytest
from pyspark.sql import functions as F

from blockyard.functions.taxonomy import TYPE_LISTS, type_lists_table, with_type_list
from blockyard.operators import labels as la
from blockyard.operators.policies import POLICIES, Policy, PolicySet, apply_policies

ROWS = "page_id long, idx int, tag string, text string, text_length int, final string"


def page(spark):
    return spark.createDataFrame([
        (1, 0, "h2", "Related stories", 15, "related"), (1, 1, "div", "a card", 6, "teaser_card"), (1, 2, "div", "a card", 6, "teaser_card"),
        (1, 3, "h3", "Most read", 9, "heading"), (1, 4, "div", "a card", 6, "teaser_card"), (1, 5, "h3", "Trending " * 9, 81, "trending"),
        (2, 0, "div", "a card", 6, "teaser_card"), (2, 1, None, None, None, None), (2, 2, "div", "a card", 6, "teaser_card"), (3, 0, "h2", "see also", 8, "related"),
    ], ROWS)


def told(df):
    return {(r["page_id"], r["idx"]): (r["policy"], r["final"]) for r in df.collect()}


def test_usual_policies(spark):
    got = told(apply_policies(page(spark)))
    changed = {k: v for k, v in got.items() if v[0]}
    assert len(got) == 10 and changed == {(1, 0): ("heading-is-heading", "heading"), (1, 1): ("related-slot", "related"), (1, 4): ("trending-slot", "trending"), (3, 0): ("heading-is-heading", "heading")}
    assert got[(2, 1)] == (None, None) and got[(2, 0)] == got[(2, 2)] == (None, "teaser_card")


def test_own_policies(spark):
    last = Policy("last-card", F.concat(F.lit("last_"), F.col("final")), lambda before, after: (F.col("final") == "teaser_card") & after("idx").isNull())
    same = Policy("no-change", "teaser_card", lambda before, after: F.col("final") == "teaser_card")
    own = POLICIES.without("trending-slot").add(same, before="related-slot").add(last)
    assert own.names() == ["heading-is-heading", "no-change", "related-slot", "last-card"]
    got = told(own.apply(page(spark)))
    # A policy that would change nothing lets the next one decide.
    assert got[(1, 1)] == ("related-slot", "related") and got[(1, 4)] == (None, "teaser_card") and got[(2, 2)] == ("last-card", "last_teaser_card")
    other = Policy("related-slot", "promo", lambda before, after: F.col("idx") == 1)
    assert own.add(other).names() == own.names() and told(own.add(other).apply(page(spark)))[(1, 1)] == ("related-slot", "promo")
    assert own.add(other, before="no-change").names() == ["heading-is-heading", "related-slot", "no-change", "last-card"]
    assert {v[0] for v in told(PolicySet().apply(page(spark))).values()} == {None}
    with pytest.raises(KeyError):
        own.add(Policy("new", "ad", lambda before, after: F.lit(True)), before="nothing")


def test_own_policies_on_an_empty_table_and_clashing_names(spark):
    rows = page(spark).withColumns({"policy": F.lit("old"), "name": F.lit("n"), "kind": F.lit("k")})
    assert told(apply_policies(rows)) == told(apply_policies(page(spark))) and "name" in apply_policies(rows).columns
    assert apply_policies(rows.limit(0)).count() == 0


def test_lists_of_types():
    assert [len(set(TYPE_LISTS[n])) for n in ("v49", "v109")] == [49, 109]
    assert with_type_list("own", ["a", "b"])["own"] == ("a", "b") and "own" not in TYPE_LISTS
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            with_type_list("own", bad)


def test_use_of_lists(spark):
    lists = type_lists_table(spark, {"one": ("a", "b", "c"), "two": ("x",)})
    rows = spark.createDataFrame([("a",), ("a",), ("b",), ("x",), ("y",), (None,)], "choice string")
    assert sorted(la.list_use(rows, lists).collect()) == [("one", 3, 2, 5, 2), ("two", 1, 1, 5, 4)]
    assert sorted(la.list_use(rows.limit(0), lists).collect()) == [("one", 3, 0, 0, 0), ("two", 1, 0, 0, 0)]


def test_probabilities_within_a_list(spark):
    rows = spark.createDataFrame([(1, {"a": 0.5, "b": 0.25, "x": 0.25}), (2, {"x": 1.0}), (3, {"a": 0.0}), (4, None), (5, {})], "id int, probabilities map<string,double>")
    kept = la.within_types(rows, ("a", "b"))
    assert {r["id"]: r["probabilities"] for r in kept.collect()} == {1: {"a": 2 / 3, "b": 1 / 3}, 2: {}, 3: {}, 4: None, 5: {}}
    ranked = {r["id"]: (r["choice"], r["confidence"]) for r in la.rank_probabilities(kept).collect()}
    assert ranked == {1: ("a", 0.667), 2: (None, None), 3: (None, None), 4: (None, None), 5: (None, None)}
