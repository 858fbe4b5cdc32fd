"""Scorecards: calls against labels, in long tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sites import split_of
from ..functions.taxonomy import types_table


def scored_rows(labels: DataFrame, calls: DataFrame) -> DataFrame:
    """Labels (page_id, idx, site, final, block, slot, review, runner_up) with calls (type, rule, call_block, call_slot) and what is right."""
    rows = labels.join(calls, ["page_id", "idx"])
    either = (F.col("review") == "either") & (F.col("type") == F.col("runner_up"))
    strict, block, slot = F.col("type") == F.col("final"), F.col("block") == F.col("call_block"), F.col("slot") == F.col("call_slot")
    return rows.withColumns({"strict": strict, "lenient": strict | F.coalesce(either, F.lit(False)), "block_ok": block, "slot_ok": slot, "axes_ok": block & slot, "split": split_of(F.col("site"))})


def _share(name: str):
    return F.round(F.avg(F.col(name).cast("int")), 3)


def type_scores(rows: DataFrame) -> DataFrame:
    """(scope, type, n, called, precision, recall, f1) for all rows and for each split: one aggregation with grouping sets."""
    sides = rows.select("split", F.explode(F.array(F.struct(F.col("final").alias("type"), F.lit(1).alias("n"), F.lit(0).alias("called"), F.col("strict").cast("int").alias("tp")), F.struct(F.col("type").alias("type"), F.lit(0).alias("n"), F.lit(1).alias("called"), F.lit(0).alias("tp")))).alias("s")).select("split", "s.*")
    totals = sides.rollup("type", "split").agg(F.sum("n").alias("n"), F.sum("called").alias("called"), F.sum("tp").alias("tp"), F.grouping("split").alias("g"), F.grouping("type").alias("t")).filter("t = 0")
    p = F.when(F.col("called") > 0, F.col("tp") / F.col("called")).otherwise(0.0)
    r = F.when(F.col("n") > 0, F.col("tp") / F.col("n")).otherwise(0.0)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    scope = F.when(F.col("g") == 1, "all").otherwise(F.col("split"))
    return totals.select(scope.alias("scope"), "type", "n", "called", F.round(p, 3).alias("precision"), F.round(r, 3).alias("recall"), F.round(f1, 3).alias("f1"))


def score(rows: DataFrame) -> DataFrame:
    """(scope, regions, strict, lenient, block, slot, axes, macro_f1); the last over types with five regions or more."""
    shares = [F.count("*").alias("regions"), *(_share(c).alias(a) for c, a in (("strict", "strict"), ("lenient", "lenient"), ("block_ok", "block"), ("slot_ok", "slot"), ("axes_ok", "axes")))]
    heads = rows.rollup("split").agg(*shares, F.grouping("split").alias("g")).withColumn("scope", F.when(F.col("g") == 1, "all").otherwise(F.col("split"))).drop("split", "g")
    macro = type_scores(rows).filter("n >= 5").groupBy("scope").agg(F.round(F.avg("f1"), 3).alias("macro_f1"))
    return heads.join(macro, "scope", "left").withColumn("macro_f1", F.coalesce("macro_f1", F.lit(0.0)))


def confusions(rows: DataFrame, most: int = 60) -> DataFrame:
    """(final, type, n, rules) of calls that are not even leniently right; rules counts each rule's part. The most frequent ``most``."""
    by_rule = rows.filter("not lenient").groupBy("final", "type", "rule").agg(F.count("*").alias("c"))
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rule", "c"))), lambda x: F.concat_ws(":", x["rule"], x["c"].cast("string"))), ",")
    return by_rule.groupBy("final", "type").agg(F.sum("c").alias("n"), told.alias("rules")).orderBy(F.desc("n"), "final", "type").limit(most)


def confusion_examples(rows: DataFrame, most: int = 4) -> DataFrame:
    """(final, type, place, page_id, idx, rule, tag, snippet): the first ``most`` regions of each confusion; a task keeps no more of one before the shuffle."""
    first = Window.partitionBy("final", "type").orderBy("page_id", "idx")
    seen = rows.filter("not lenient").withColumn("place", F.row_number().over(first)).filter(F.col("place") <= most)
    return seen.select("final", "type", "place", "page_id", "idx", "rule", "tag", F.translate(F.left("text", F.lit(80)), "\n", " ").alias("snippet"))


def rule_use(rows: DataFrame) -> DataFrame:
    return rows.groupBy("rule").agg(F.count("*").alias("n"), F.sum(F.col("lenient").cast("long")).alias("right"))


def least_reliable(use: DataFrame, least: int = 10, most: int = 12) -> DataFrame:
    return use.filter(F.col("n") >= least).withColumn("share", F.round(F.col("right") / F.col("n"), 3)).orderBy("share", F.desc("n"), "rule").limit(most)


def page_scores(rows: DataFrame) -> DataFrame:
    return rows.groupBy("page_id", "split").agg(F.count("*").alias("regions"), F.round(F.avg(F.col("strict").cast("int")), 2).alias("strict"))


def slot_scores(rows: DataFrame) -> DataFrame:
    return rows.groupBy("slot").agg(F.count("*").alias("n"), F.sum(F.col("slot_ok").cast("long")).alias("ok"))


def stack_calls(rows: DataFrame, blend: float = 0.7) -> DataFrame:
    """Adds stack_type, source and confidence: the directory, else trees at ``blend`` or above, else the rules."""
    tree = F.when(F.col("tree_conf") >= blend, F.col("tree_type"))
    source = F.when(F.col("directory_type").isNotNull(), "directory").when(tree.isNotNull(), "trees").otherwise("rules")
    return rows.withColumns({"stack_type": F.coalesce("directory_type", tree, "type"), "source": source, "confidence": F.when(source == "trees", F.col("tree_conf"))})


def stack_score(rows: DataFrame, blend: float = 0.7) -> DataFrame:
    """One row: n and how many the rules, the trees, trees then rules, the directory and the whole stack have right."""
    tree = F.when(F.col("tree_conf") >= blend, F.col("tree_type"))
    right = lambda c: F.sum(F.coalesce(c == F.col("final"), F.lit(False)).cast("long"))
    return rows.agg(
        F.count("*").alias("n"), right(F.col("type")).alias("rules"), right(F.coalesce("tree_type", "type")).alias("trees"), right(F.coalesce(tree, "type")).alias("trees_then_rules"),
        F.count("directory_type").alias("covered"), right(F.col("directory_type")).alias("directory_right"), right(F.coalesce("directory_type", tree, "type")).alias("stack"),
    )


THRESHOLDS = (0.0, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


def _blended(rows: DataFrame, thresholds: tuple[float, ...], *by: str) -> DataFrame:
    each = rows.select("final", "type", "tree_type", "tree_conf", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    call = F.when(F.col("tree_conf") >= F.col("threshold"), F.col("tree_type")).otherwise(F.col("type"))
    return each.groupBy("threshold", *by).agg(F.count("*").alias("n"), F.sum((call == F.col("final")).cast("long")).alias("right"))


def blend_sweep(rows: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """(threshold, n, right): trees at the threshold or above, else rules."""
    return _blended(rows, thresholds)


def blend_sweep_by_type(rows: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, least: int = 5) -> DataFrame:
    """(threshold, type, n, right) of the types with ``least`` labels or more."""
    return _blended(rows, thresholds, "final").filter(F.col("n") >= least).withColumnRenamed("final", "type")


def disposition_score(rows: DataFrame, blend: float = 0.7, sure: float = 0.8) -> DataFrame:
    """(variant, truth, keep, demote, drop): regions of each true disposition by the one that rules, stack and careful stack call; types outside the taxonomy are kept."""
    spark = rows.sparkSession
    of = lambda kind, name: F.broadcast(types_table(spark).select(F.col("type").alias(kind), F.col("disposition").alias(name)))
    known = stack_calls(rows, blend)
    for kind, name in (("final", "truth"), ("type", "d_rules"), ("stack_type", "d_stack")):
        known = known.join(of(kind, name), kind, "left").withColumn(name, F.coalesce(name, F.lit("keep")))
    certain = F.col("directory_type").isNotNull() | F.coalesce((F.col("tree_conf") >= sure) & (F.col("tree_type") == F.col("stack_type")), F.lit(False))
    careful = F.when((F.col("d_stack") == "drop") & ~certain, "demote").otherwise(F.col("d_stack"))
    each = known.select("truth", F.explode(F.array(F.struct(F.lit("rules").alias("variant"), F.col("d_rules").alias("d")), F.struct(F.lit("stack").alias("variant"), F.col("d_stack").alias("d")), F.struct(F.lit("careful").alias("variant"), careful.alias("d")))).alias("x")).select("truth", "x.*")
    return each.groupBy("variant", "truth").agg(*(F.sum((F.col("d") == d).cast("long")).alias(d) for d in ("keep", "demote", "drop")))


def scorecard_diff(now: DataFrame, before: DataFrame, least: int = 5, fall: float = 0.05) -> DataFrame:
    """(scope, type, f1, f1_before, delta, regressed) of two ``type_scores``; types of one run alone have a null side."""
    a = now.select("scope", "type", "n", "f1")
    b = before.select("scope", "type", F.col("f1").alias("f1_before"))
    delta = F.round(F.col("f1") - F.col("f1_before"), 3)
    return a.join(b, ["scope", "type"], "full_outer").select("scope", "type", "f1", "f1_before", delta.alias("delta"), F.coalesce((F.col("n") >= least) & (delta < -fall), F.lit(False)).alias("regressed"))


def headline_diff(now: DataFrame, before: DataFrame) -> DataFrame:
    """(scope, measure, value, before, delta) of two ``score`` tables; a scope of one run alone has a null side."""
    names = ["strict", "lenient", "block", "slot", "axes", "macro_f1"]
    long = lambda card, value: card.select("scope", *(F.col(c).cast("double") for c in names)).unpivot("scope", names, "measure", value)
    met = long(now, "value").join(long(before, "before"), ["scope", "measure"], "full_outer")
    return met.withColumn("delta", F.round(F.col("value") - F.col("before"), 3))
