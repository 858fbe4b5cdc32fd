"""Readers and writers of the pipeline's files; every schema is declared, none is inferred."""

from __future__ import annotations

import functools
import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sites import split_of
from ..functions.urls import host
from .shared import materialise

CAPTURE = (
    "id string, site string, kind string, tier string, notes string, requestedUrl string, url string, title string, capturedAt timestamp, "
    "viewport struct<width:int,height:int>, pageHeight int, scrollSteps int, regions int, elements int, domBytes long, domTruncated boolean, "
    "blockedRequests int, scriptlets int, lastError string, shotError string, ms long"
)
RULE_SET = (
    "title string, enabled boolean, match array<string>, block array<string>, redirect array<struct<from:string,to:string>>, css string, js string, "
    "mainJs string, options map<string,string>, tier string, _corrupt_record string"
)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Captured pages (page_id, url, html) with site and split."""
    pages = spark.read.schema("page_id long, url string, html string").parquet(path)
    return pages.withColumn("site", host(F.col("url"))).withColumn("split", split_of(F.col("site")))


def read_corpus(spark: SparkSession, regions: str, labels: str, labelled: bool = True) -> DataFrame:
    """Regions with their labels; ``labelled`` keeps only pages that have labels."""
    r, la = spark.read.parquet(regions), spark.read.parquet(labels)
    pages = la.select("page_id").distinct()
    kept = r.join(pages, "page_id", "left_semi") if labelled else r
    return kept.join(la, ["page_id", "idx"], "left").withColumn("split", split_of(F.col("site")))


def read_captures(spark: SparkSession, path: str, names: str = "meta.json") -> DataFrame:
    """Captures below ``path`` in files whose name fits ``names``: one JSON object a file, or a list of them (``write_captures``)."""
    return spark.read.schema(CAPTURE).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", names).json(path)


def write_captures(captures: DataFrame, path: str, per_file: int = 500) -> None:
    """Captures as files of JSON lists, about ``per_file`` each: a file a capture costs more than the capture."""
    lists = max(1, captures.count() // per_file)
    dealt = captures.groupBy(F.pmod(F.xxhash64("id"), F.lit(lists)).alias("_list")).agg(F.to_json(F.collect_list(F.struct(*captures.columns))).alias("value"))
    dealt.select("value").write.option("maxRecordsPerFile", 1).text(path)


def read_rule_sets(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rules, bad): rule sets by file name, and the files that are no JSON; set_pos follows the file names."""
    raw = spark.read.schema(RULE_SET).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    # A corrupt-record column can't be read alone, so the rows are kept first.
    held = materialise(raw.withColumn("name", name), "rule-sets")
    order = F.row_number().over(_by_name())
    good = held.filter("_corrupt_record is null").drop("_corrupt_record").withColumn("set_pos", order - 1).withColumn("enabled", F.coalesce("enabled", F.lit(True)))
    return good, held.filter("_corrupt_record is not null").select("name", "_corrupt_record")


def _by_name():
    from pyspark.sql import Window

    return Window.orderBy("name")


def rule_tables(rules: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(match, redirect, block) rows of rule sets."""
    match = rules.select("set_pos", "name", "enabled", F.explode("match").alias("pattern"))
    redirect = rules.select("set_pos", F.posexplode("redirect").alias("pos", "r")).select("set_pos", "pos", "r.from", "r.to")
    block = rules.select("set_pos", F.posexplode("block").alias("pos", "pattern"))
    return match, redirect, block


def read_filters(spark: SparkSession, path: str, custom: bool = False) -> DataFrame:
    """(pos, custom, line) of filter lists; empty lines are left out, pos keeps the order within a file."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.monotonically_increasing_id().alias("pos"), F.lit(custom).alias("custom"), F.trim("value").alias("line"))


def read_site_list(spark: SparkSession, path: str) -> DataFrame:
    """(site, urls): a URL per line, # starts a comment; a URL without scheme is https."""
    line = F.trim(F.regexp_replace("value", "#.*", ""))
    urls = spark.read.text(path).select(line.alias("u")).filter("u != ''").select(F.when(F.col("u").contains("://"), F.col("u")).otherwise(F.concat(F.lit("https://"), "u")).alias("url"))
    return urls.withColumn("site", host(F.col("url"))).filter("site is not null").groupBy("site").agg(F.array_sort(F.collect_set("url")).alias("urls"))


def read_judgements(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, idx, verdict) of maps from page:idx to a verdict."""
    each = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("id", "verdict"))
    return each.select(F.substring_index("id", ":", 1).alias("page_id"), F.substring_index("id", ":", -1).cast("int").alias("idx"), "verdict")


def write_directory(directory: DataFrame, path: str) -> None:
    """One partition per site; sites that are not in ``directory`` stay as they are."""
    directory.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("site").parquet(path)


MANIFEST = "version long, label string, folder string"


def versions(spark: SparkSession, path: str) -> list[tuple[int, str, str]]:
    """(version, label, folder) of what was published under ``path``, oldest first."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").collect()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = []
    return sorted((r["version"], r["label"], f"{path}/{r['folder']}") for r in rows)


def publish(table: DataFrame, path: str, label: str = "") -> int:
    """Write ``table`` as a new version under ``path``; gives its number.

    The rows go to a folder of their own. Only when all are there is one row added to the manifest, as one file that is
    moved into place; until then, and if the write fails, readers see the version before. Nothing is ever overwritten.
    """
    spark, folder = table.sparkSession, f"versions/{uuid.uuid4().hex}"
    table.write.parquet(f"{path}/{folder}")
    number = max((v for v, _, _ in versions(spark, path)), default=0) + 1
    spark.createDataFrame([(number, label, folder)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return number


def published(spark: SparkSession, path: str) -> DataFrame | None:
    """The last version published under ``path``, or None."""
    held = versions(spark, path)
    return spark.read.parquet(held[-1][2]) if held else None


def write_scorecard(card: DataFrame, path: str, run_id: str, filtered: bool = False) -> DataFrame | None:
    """Publish the card of a run; the one before, if any, is returned. Filtered runs write nothing."""
    if filtered:
        return None
    before = published(card.sparkSession, path)
    publish(card.withColumn("run_id", F.lit(run_id)), path, run_id)
    return before


def scorecard_history(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of all cards, each with its run_id, or None."""
    held = versions(spark, path)
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.parquet(f) for _, _, f in held]) if held else None


def publish_directory(directory: DataFrame, path: str) -> int:
    """Publish entries: sites of ``directory`` replace their older rows, other sites' rows are carried over."""
    before = published(directory.sparkSession, path)
    if before is not None:
        kept = before.join(directory.select("site").distinct(), "site", "left_anti")
        directory = kept.unionByName(directory, allowMissingColumns=True)
    return publish(directory, path, "directory")


def write_oof(calls: DataFrame, path: str) -> None:
    """Out-of-fold calls (page_id, idx, tree_type, tree_conf), confidence to three decimals."""
    calls.select("page_id", "idx", "tree_type", F.round("tree_conf", 3).alias("tree_conf")).write.mode("overwrite").parquet(path)


def read_oof(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("page_id long, idx int, tree_type string, tree_conf double").parquet(path)


def save_model(spark: SparkSession, model: dict, path: str) -> None:
    """A tree model, one small object, as JSON text."""
    spark.createDataFrame([(json.dumps(model),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_model(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])
