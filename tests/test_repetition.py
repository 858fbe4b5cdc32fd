"""Repetition on one huge site, and sketches of pages that add up."""

from pyspark.sql import functions as F

from blockyard.operators import regions as re_
from blockyard.operators.joins import join_counted

REGION = "site string, page_id long, idx int, tag string, class string, text string, text_length int"


def one_huge_site(spark, pages=400):
    """One site has nine tenths of the regions; its footer is on every page."""
    rows = []
    for p in range(pages):
        site = "huge.example" if p % 10 else f"s{p}.example"
        rows += [(site, p, i, "p", None, t, len(t)) for i, t in enumerate((f"only on page {p}", f"on some pages {p % 7}", "the footer of every page", "tiny"))]
    return spark.createDataFrame(rows, REGION).repartition(6)


def test_huge_sites_are_joined_like_others(spark):
    df = one_huge_site(spark)
    told = lambda d: sorted((r["page_id"], r["idx"], r["site_pages"], r["repeat_pages"], r["repeated"], round(r["repeat_frac"], 9)) for r in d.collect())
    usual = told(re_.with_repetition(df))
    assert told(re_.with_repetition(df, per_task=50)) == usual == told(re_.with_repetition(df, per_task=0))
    assert len(usual) == 1600 and (1, 2, 360, 360, True, 1.0) in usual and (1, 3, 360, 0, False, 0.0) in usual


def test_a_hot_key_fills_no_task(spark):
    left = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id")).alias("k"), F.col("id").alias("v"))
    left = left.withColumn("k", F.coalesce("k", F.lit(-1))).union(spark.range(500).selectExpr("cast(null as long)", "-id"))
    right = left.filter("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = join_counted(left, right, ["k"], "n", per_task=1000)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert out.count() == 20_500 and out.filter("n = 18000").count() == 18_000 and out.filter("n is null").count() == 500
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(sizes) == 4 and max(sizes) < 3 * sorted(sizes)[1]


def test_sketches_of_days_add_up(spark):
    many = spark.range(60_000).select(F.lit("a.example").alias("site"), F.col("id").alias("page_id"), F.lit(0).alias("idx"), F.lit("p").alias("tag"), F.lit(None).cast("string").alias("class"), F.lit("the footer of every page").alias("text"), F.lit(24).alias("text_length"))
    first, second = re_.site_sketches(many.filter("page_id < 40000")), re_.site_sketches(many.filter("page_id >= 30000"))
    got = re_.sketched_index(re_.merge_sketches(first, second)).collect()
    assert len(got) == 1 and abs(got[0]["repeat_pages"] - 60_000) < 0.05 * 60_000
    df = one_huge_site(spark, 90)
    days = [re_.site_sketches(df.filter(f"page_id % 3 = {d}")) for d in range(3)]
    merged = re_.sketched_index(re_.merge_sketches(re_.merge_sketches(days[0], days[1]), days[2]))
    assert {tuple(r) for r in merged.collect()} == {tuple(r) for r in re_.site_index(df).collect()}


def test_days_that_overlap_add_up_exactly(spark):
    """However many pages a signature has, and whatever their ids."""
    ids = spark.range(70_000).select(F.expr("case when id % 2 = 0 then id * 1000003 else -id end").alias("page_id"), F.lit("a.example").alias("site"), F.lit(0).alias("idx"), F.lit("p").alias("tag"), F.lit("c").alias("class"))
    many = ids.withColumns({"text": F.expr("case when page_id % 3 = 0 then 'on every third page' else 'on the other pages' end"), "text_length": F.lit(20)})
    merged = re_.sketched_index(re_.merge_sketches(re_.site_sketches(many.filter("page_id % 5 < 4")), re_.site_sketches(many.filter("page_id % 5 > 1 or page_id % 5 < 1"))))
    assert {tuple(r) for r in merged.collect()} == {tuple(r) for r in re_.site_index(many).collect()}
