"""Directories: selectors of a site that stand for one type, derived from its labelled pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.selectors import is_bare, selector_of
from ..functions.urls import parent_host

PURITY, LEAST_BARE = 0.75, 3


def with_selector(regions: DataFrame) -> DataFrame:
    element_id = F.col("id") if "id" in regions.columns else F.lit(None).cast("string")
    return regions.withColumn("selector", selector_of(F.col("landmarks"), F.col("tag"), element_id, F.col("class")))


def _accepted(n: Column, best: Column) -> Column:
    return (best / n >= PURITY) & ~(is_bare(F.col("selector")) & (n < LEAST_BARE))


def derive_directory(labelled: DataFrame) -> DataFrame:
    """(site, selector, type, n, purity, pages) of rows (site, page_id, selector, final): the majority type of each selector.

    Ties go to the type first by name. Kept are selectors of one type in three quarters of their regions; a bare tag
    needs three regions.
    """
    by_type = labelled.groupBy("site", "selector", "final").agg(F.count("*").alias("c"))
    pages = labelled.select("site", "selector", "page_id").distinct().groupBy("site", "selector").agg(F.count("*").alias("pages"))
    best = by_type.groupBy("site", "selector").agg(F.sum("c").alias("n"), F.min_by("final", F.struct(-F.col("c"), F.col("final"))).alias("type"), F.max("c").alias("best"))
    good = best.filter(_accepted(F.col("n"), F.col("best"))).join(pages, ["site", "selector"])
    return good.select("site", "selector", "type", "n", F.round(F.col("best") / F.col("n"), 2).alias("purity"), "pages")


def site_tiers(pages: DataFrame) -> DataFrame:
    """(site, tier): the most frequent tier of a site's pages; pages set by hand outrank the directory's own."""
    counted = pages.groupBy("site", "tier").agg(F.count("*").alias("n"), F.sum((F.col("kind") != "directory").cast("int")).alias("by_hand"))
    first = F.struct(-F.col("by_hand"), F.when(F.col("by_hand") > 0, 0).otherwise(-F.col("n")), F.col("tier"))
    return counted.groupBy("site").agg(F.min_by("tier", first).alias("tier"))


def directory_calls(regions: DataFrame, directory: DataFrame, parent: bool = True) -> DataFrame:
    """Adds directory_type. A site without an entry takes its parent host's; an entry counts as a whole, not by selector."""
    sites = directory.select("site").distinct()
    asked = regions.select("site").distinct()
    hosts = asked.select("site", F.posexplode(F.array(F.col("site"), parent_host(F.col("site"))) if parent else F.array("site")).alias("place", "entry"))
    entry = hosts.join(sites.withColumnRenamed("site", "entry"), "entry").groupBy("site").agg(F.min_by("entry", "place").alias("entry"))
    found = entry.join(directory.select(F.col("site").alias("entry"), "selector", F.col("type").alias("directory_type")), "entry").drop("entry")
    return regions.join(found, ["site", "selector"], "left")


def directory_lopo(labelled: DataFrame) -> DataFrame:
    """Adds directory_type derived from the site's other pages; null on sites of one page.

    A page's own counts are subtracted from the site's, and the rule is applied to what is left: one pass over counts
    instead of one derivation per page.
    """
    own = labelled.groupBy("site", "selector", "page_id", "final").agg(F.count("*").alias("own"))
    total = own.groupBy("site", "selector", "final").agg(F.sum("own").alias("c"))
    asked = own.select("site", "selector", "page_id").distinct()
    left = asked.join(total, ["site", "selector"]).join(own, ["site", "selector", "page_id", "final"], "left")
    left = left.withColumn("c", F.col("c") - F.coalesce("own", F.lit(0))).filter("c > 0")
    best = left.groupBy("site", "selector", "page_id").agg(F.sum("c").alias("n"), F.min_by("final", F.struct(-F.col("c"), F.col("final"))).alias("directory_type"), F.max("c").alias("best"))
    good = best.filter(_accepted(F.col("n"), F.col("best"))).select("site", "selector", "page_id", "directory_type")
    return labelled.join(good, ["site", "selector", "page_id"], "left")


def lopo_score(rows: DataFrame) -> DataFrame:
    """Per site of two pages or more: regions, covered, right where covered, directory alone, rules alone, directory then rules."""
    pages = rows.groupBy("site").agg(F.count_distinct("page_id").alias("pages"))
    right = lambda c: F.sum(F.coalesce(c == F.col("final"), F.lit(False)).cast("long"))
    scored = rows.join(pages.filter("pages >= 2"), "site").groupBy("site").agg(
        F.count("*").alias("regions"), F.count("directory_type").alias("covered"), right(F.col("directory_type")).alias("right_covered"),
        right(F.col("type")).alias("rules_right"), right(F.coalesce("directory_type", "type")).alias("combined_right"),
    )
    return scored


def resolve_tier(pages: DataFrame, site_tier: DataFrame, rule_tier: DataFrame, overrides: DataFrame, default: str = "contained") -> DataFrame:
    """Adds tier and reason: override, else the last matching rule set's, else the site's, else the default."""
    rules = rule_tier.filter("tier is not null").groupBy("page_id").agg(F.max_by("tier", "set_pos").alias("rule_tier"))
    out = pages.join(site_tier.select("site", F.col("tier").alias("entry_tier")), "site", "left").join(rules, "page_id", "left")
    out = out.join(overrides.select("page_id", F.col("tier").alias("own_tier")), "page_id", "left")
    reason = F.when(F.col("own_tier").isNotNull(), "override").when(F.col("rule_tier").isNotNull(), "rule").when(F.col("entry_tier").isNotNull(), "site").otherwise("default")
    return out.withColumn("tier", F.coalesce("own_tier", "rule_tier", "entry_tier", F.lit(default))).withColumn("reason", reason).drop("own_tier", "rule_tier", "entry_tier")


def merge_directory(existing: DataFrame, derived: DataFrame) -> DataFrame:
    """Entries after a new derivation: a derived site's rows replace its old ones, and keep what columns it does not derive say of the site; other sites stay."""
    kept = existing.join(derived.select("site").distinct(), "site", "left_anti")
    unknown = [c for c in existing.columns if c not in derived.columns]
    if unknown:
        told = existing.groupBy("site").agg(*(F.any_value(c, F.lit(True)).alias(c) for c in unknown))
        derived = derived.join(told, "site", "left")
    return kept.unionByName(derived, allowMissingColumns=True)


def ranked(directory: DataFrame) -> DataFrame:
    """Adds place: the order of a site's selectors, most regions first, ties by name."""
    return directory.withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("n"), "selector")))
