"""Pages to blocks: which regions of every page are kept, and how much of a page is content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import regions as re_
from ..operators import trees
from ..operators.directory import derive_directory, directory_calls, with_selector
from ..operators.extract import extract_regions
from ..operators.links import eligible, gate_pages
from ..operators.rules import CORE, RuleSet, classify_rules, lower_text, with_flags
from ..operators.scoring import stack_calls
from ..operators.vectors import NAMES, vectorize
from ..sources.shared import materialise


def region_features(pages: DataFrame) -> DataFrame:
    """Extracted regions with flags, repetition, neighbours and text features.

    Extraction and flags are the costly steps and the site index, the page counts and the features all read their rows,
    so they are written once to the shared folder. Texts travel once, their lower case is made again where it is read.
    """
    found = materialise(re_.drop_empty(with_flags(extract_regions(pages)).drop("low")), "regions")
    # Rules cost much time a row, so partitions by page are not merged by their bytes; all later windows use them.
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = re_.with_repetition(found).repartition(parts, "page_id")
    return re_.with_text_features(re_.with_neighbours(dealt)).withColumn("low", lower_text())


def classify_pages(pages: DataFrame, directory: DataFrame | None = None, model: trees.Model | None = None, rules: RuleSet = CORE, blend: float = 0.5) -> DataFrame:
    """Calls per region: type, rule, tree_type, directory_type, source, block, slot, disposition.

    Pages that are no web pages (``links.eligible``) have no calls. Rules decide; a tree ``model`` of ``vectors.NAMES``
    decides where it is sure enough (``blend``), and a ``directory`` over both.
    """
    called = classify_rules(region_features(eligible(pages).filter("eligible").drop("eligible")), rules)
    none = F.lit(None).cast("string")
    called = directory_calls(with_selector(called), directory) if directory is not None else called.withColumn("directory_type", none)
    if model is None:
        called = called.withColumn("tree_type", none).withColumn("tree_conf", F.lit(None).cast("double"))
    else:
        called = trees.predict(vectorize(called), model).drop("features")
    return re_.with_disposition(re_.derive_axes(stack_calls(called, blend), "stack_type"), "stack_type")


def learned_stack(pages: DataFrame, teacher: Column, options: trees.Options | None = None) -> tuple[DataFrame, DataFrame, trees.Model]:
    """Calls of the pages that ``teacher`` does not choose by the whole stack: rules, trees, and the sites' directory.

    The directory and the trees are made from the rules' own calls on the pages that ``teacher`` chooses, as a site's older
    pages are used when nothing is labelled by hand. Also gives the directory and the model.
    """
    dealt = materialise(eligible(pages).filter("eligible").drop("eligible").withColumn("_teacher", F.coalesce(teacher, F.lit(False))), "dealt")
    told = materialise(vectorize(classify_rules(region_features(dealt.filter("_teacher").drop("_teacher")))).select("page_id", "site", "landmarks", "tag", "class", "type", "features"), "taught")
    directory = materialise(derive_directory(with_selector(told).withColumnRenamed("type", "final")), "directory")
    model = trees.train(told, "type", len(NAMES), options or trees.Options(rounds=8, depth=3, rate=0.3), names=NAMES)
    return classify_pages(dealt.filter("not _teacher").drop("_teacher"), directory, model), directory, model


def page_blocks(pages: DataFrame, directory: DataFrame | None = None, model: trees.Model | None = None) -> DataFrame:
    """Per page: counts by disposition and source, characters kept, the share of the page's text that is content, tier and reason.

    One aggregation over the calls, whose rows already lie by page.
    """
    return count_blocks(classify_pages(pages, directory, model))


def count_blocks(calls: DataFrame) -> DataFrame:
    """The rows of ``page_blocks`` from the calls of their regions."""
    kept = F.sum(F.when(F.col("disposition") == "keep", F.col("text_length")).otherwise(0)).alias("kept_chars")
    out = re_.page_counts(calls, F.first("site").alias("site"), kept, F.sum("text_length").alias("chars"))
    out = out.withColumn("content_share", F.round(F.col("kept_chars") / F.greatest(F.col("chars"), F.lit(1)), 3))
    return gate_pages(out.withColumnsRenamed({"total": "regions", "keep": "kept"})).withColumnsRenamed({"regions": "total", "kept": "keep"})
