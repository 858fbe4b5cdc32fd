"""Anchors that lie over regions: cards are often links as a whole, without text of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import overlap

# Least size of an anchor, and the shares that make it cover a region or a member of it.
LEAST_WIDTH, LEAST_HEIGHT, OF_REGION, OF_ANCHOR, OF_MEMBER, LABEL = 20, 10, 0.5, 0.9, 0.4, 120
BAND = 512  # pixels: rectangles meet only where they touch the same band of a page


def anchor_boxes(pages: DataFrame) -> DataFrame:
    """(page_id, pos, left, top, width, height, label) of the visible anchors with a target and a box in the markup."""
    tags = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?i)<a\b([^>]*)>"), F.lit(1))).alias("pos", "a"))
    px = F.transform(F.split(F.regexp_extract("a", r'data-mx-r="([^"]*)"', 1), ","), lambda x: x.try_cast("double"))
    label = F.coalesce(*(F.nullif(F.regexp_extract("a", rf' {k}="([^"]*)"', 1), F.lit("")) for k in ("aria-label", "title")))
    plain = F.trim(F.replace(F.replace(label, F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&")))
    good = tags.filter(F.col("a").rlike(r'(?i) href="') & ~F.col("a").contains('data-mx-h="1"')).withColumn("px", px).filter("size(px) = 4 and forall(px, x -> x is not null)")
    return good.select("page_id", "pos", *(F.col("px")[i].alias(n) for i, n in enumerate(("left", "top", "width", "height"))), F.nullif(plain, F.lit("")).alias("label"))


def with_cover_links(regions: DataFrame, anchors: DataFrame) -> DataFrame:
    """``regions`` (page_id, idx, left, top, width, height, repeats) with cover_links and cover_label.

    An anchor counts if it shares half of the region's area, or lies within it by nine tenths and has four tenths of the
    area of a member. The label is that of the first such anchor that has one. Pairs meet by page and band; each pair
    counts in the first band that both touch.
    """
    big = anchors.filter((F.col("width") >= LEAST_WIDTH) & (F.col("height") >= LEAST_HEIGHT))
    whole = regions.withColumns({"width": F.greatest("width", F.lit(1.0)), "height": F.greatest("height", F.lit(1.0))})
    bands = lambda df: F.sequence(F.floor(F.col("top") / BAND), F.floor((F.col("top") + F.col("height")) / BAND))
    shape = lambda df, p: df.select("page_id", *(F.col(c).alias(f"{p}_{c}") for c in df.columns if c != "page_id"), F.explode(bands(df)).alias("band"), F.floor(F.col("top") / BAND).alias(f"{p}_first"))
    met = shape(whole.select("page_id", "idx", "left", "top", "width", "height", "repeats"), "r").join(shape(big, "a"), ["page_id", "band"]).filter(F.col("band") == F.greatest("r_first", "a_first"))
    box = lambda p: tuple(F.col(f"{p}_{c}").cast("double") for c in ("left", "top", "width", "height"))
    area = lambda p: F.col(f"{p}_width") * F.col(f"{p}_height")
    shared = overlap(box("r"), box("a"))
    covers = (shared >= OF_REGION * area("r")) | ((shared >= OF_ANCHOR * area("a")) & (area("a") >= OF_MEMBER * area("r") / F.greatest("r_repeats", F.lit(1))))
    named = F.when(F.col("a_label").isNotNull(), F.col("a_pos"))
    found = met.filter(covers).groupBy("page_id", F.col("r_idx").alias("idx")).agg(F.count("*").alias("cover_links"), F.left(F.min_by("a_label", named), F.lit(LABEL)).alias("cover_label"))
    kept = regions.drop("cover_links", "cover_label")
    return kept.join(found, ["page_id", "idx"], "left").withColumn("cover_links", F.coalesce("cover_links", F.lit(0)).cast("int"))
