"""Links between pages: candidates for a crawl, discovery, ids and health."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import host, is_page_url, origin, path, path_depth, slug, url_key

ANCHOR = r'(?is)<a\s[^>]*?href="([^"]*)"'
FILE = r"(?i)\.(pdf|zip|jpg|png|gif|mp4|mp3|xml|rss)$"
# Path parts of pages without content of their own.
PLUMBING = r"(?i)/(login|signin|signup|register|account|cart|checkout|search|tag|tags|author|feed|rss|privacy|terms|cookies?|contact|about)(?![A-Za-z0-9_])"
BOT_WALL = r"(?iu)(are you a robot|verify you are human|captcha|access denied|unusual traffic|enable javascript and cookies|checking your browser)"


def anchors(pages: DataFrame) -> DataFrame:
    """(page_id, page_url, pos, href): every anchor's target, made absolute; fragments and scripts are left out."""
    each = pages.select("page_id", F.col("url").alias("page_url"), F.posexplode(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1))).alias("pos", "raw"))
    raw = F.col("raw")
    full = F.when(raw.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), raw).when(raw.startswith("//"), F.concat(F.regexp_extract("page_url", r"^([a-z]+:)", 1), raw)).when(raw.startswith("/"), F.concat(origin(F.col("page_url")), raw)).otherwise(F.concat(F.regexp_replace(url_key(F.col("page_url")), "[^/]*$", ""), raw))
    return each.filter(~raw.rlike(r"(?i)^(#|javascript:|mailto:)") & (raw != "")).select("page_id", "page_url", "pos", full.alias("href"))


def page_links(pages: DataFrame, most: int = 40) -> DataFrame:
    """(page_id, key, href, depth, place): a page's links to other pages of its host, deepest first, ``most`` of them."""
    links = anchors(pages).withColumn("key", url_key(F.col("href"))).withColumn("depth", path_depth(F.col("href")))
    target = path(F.col("href"))
    same = host(F.col("href")).eqNullSafe(host(F.col("page_url")))
    good = links.filter(same & ~target.rlike(FILE) & ~target.rlike(PLUMBING) & (F.col("key") != url_key(F.col("page_url"))))
    once = good.groupBy("page_id", "key").agg(F.min_by("href", "pos").alias("href"), F.min_by("depth", "pos").alias("depth"), F.min("pos").alias("pos"))
    order = Window.partitionBy("page_id").orderBy(F.desc("depth"), "pos")
    return once.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select("page_id", "key", F.regexp_replace("href", "#.*$", "").alias("href"), "depth", "place")


def discover_pages(links: DataFrame, known: DataFrame, per_site: int = 4) -> DataFrame:
    """(site, href, turn): new pages of each site, deep and shallow ones in turn, deep first, up to its quota less the known."""
    per_link = links.withColumn("site", host(F.col("href"))).groupBy("site", "href").agg(F.max("depth").alias("depth"), F.min(F.struct("page_id", "place")).alias("seen"))
    fresh = per_link.join(known.select(F.col("url").alias("href")).distinct(), "href", "left_anti")
    deep = F.col("depth") >= 2
    turn = F.row_number().over(Window.partitionBy("site", deep).orderBy(F.desc("depth"), "seen"))
    mixed = fresh.withColumn("t", turn).withColumn("d", deep.cast("int"))
    mixed = mixed.withColumn("turn", F.row_number().over(Window.partitionBy("site").orderBy("t", F.desc("d"))))
    have = known.withColumn("site", host(F.col("url"))).groupBy("site").agg(F.count("*").alias("have"))
    return mixed.join(have, "site", "left").filter(F.col("turn") <= per_site - F.coalesce("have", F.lit(0))).select("site", "href", "turn")


def allocate_ids(new_pages: DataFrame, existing: DataFrame) -> DataFrame:
    """Adds id: slug-n with the smallest numbers that the site has not taken, in the order of turn."""
    base = slug(F.col("site"))
    wanted = new_pages.withColumn("base", base).withColumn("k", F.row_number().over(Window.partitionBy("site").orderBy("turn")))
    counts = wanted.groupBy("base").agg(F.max("k").alias("need"))
    taken = existing.select("id").distinct()
    used = existing.select(F.regexp_extract("id", r"^(.*)-\d+$", 1).alias("base")).groupBy("base").agg(F.count("*").alias("used"))
    free = counts.join(used, "base", "left").select("base", F.explode(F.sequence(F.lit(1).cast("long"), F.col("need") + F.coalesce("used", F.lit(0)))).alias("n"))
    free = free.withColumn("id", F.concat_ws("-", "base", F.col("n").cast("string"))).join(taken, "id", "left_anti")
    free = free.withColumn("k", F.row_number().over(Window.partitionBy("base").orderBy("n")))
    return wanted.join(free.select("base", "k", "id"), ["base", "k"]).drop("base", "k")


def append_pages(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The page list with the new entries whose site and url it lacks."""
    return existing.unionByName(new.join(existing.select("site", "url"), ["site", "url"], "left_anti"), allowMissingColumns=True)


def resolve_via(wanted: DataFrame, links: DataFrame) -> DataFrame:
    """Adds href and error for entries (id, source_id, pattern): the first link of the source page that matches the pattern."""
    met = wanted.select("id", "source_id", "pattern").join(links.select(F.col("page_id").alias("source_id"), "href", "pos"), "source_id", "left")
    hit = F.expr("href rlike pattern")
    best = met.groupBy("id").agg(F.min_by(F.when(hit, F.col("href")), F.when(hit, F.col("pos"))).alias("href"), F.count("href").alias("links"))
    error = F.when(F.col("links") == 0, "source page missing").when(F.col("href").isNull(), "no link matches")
    return wanted.join(best, "id").withColumn("error", error).drop("links")


def eligible(pages: DataFrame) -> DataFrame:
    return pages.withColumn("eligible", is_page_url(F.col("url")))


def gate_pages(counts: DataFrame) -> DataFrame:
    """Adds tier and reason for counts (page_id, regions, kept): too little to lay out stays contained."""
    reason = F.when(F.col("regions") < 3, "few regions").when(F.col("kept") < 2, "few kept")
    return counts.withColumn("reason", reason).withColumn("tier", F.when(reason.isNull(), "relayout").otherwise("contained"))


def crawl_health(pages: DataFrame) -> DataFrame:
    """Adds status and failures for pages (title, text, elements, height, extracted, items) of a crawl."""
    start = F.concat_ws("\n", "title", F.left("text", F.lit(1500)))
    skipped = start.rlike(BOT_WALL) | ((F.length("text") < 60) & (F.coalesce("title", F.lit("")) == ""))
    tests = {"text": F.length("text") < 200, "elements": F.col("elements") < 5, "height": F.col("height") < 200, "extracted": F.col("extracted") < 100, "items": F.col("items") < 3}
    failures = F.filter(F.array(*(F.when(c, name) for name, c in tests.items())), lambda x: x.isNotNull())
    return pages.withColumn("failures", F.when(skipped, F.array().cast("array<string>")).otherwise(failures)).withColumn("status", F.when(skipped, "skipped").when(F.size("failures") > 0, "failed").otherwise("ok"))


def capture_manifest(captures: DataFrame, page_list: DataFrame) -> DataFrame:
    """(tier, listed, captured, sites, regions) by tier, pages that were listed but not captured included."""
    met = page_list.select("id", "site", "tier").join(captures.select("id", "regions"), "id", "left")
    return met.groupBy("tier").agg(F.count("*").alias("listed"), F.count("regions").alias("captured"), F.count_distinct("site").alias("sites"), F.coalesce(F.sum("regions"), F.lit(0)).alias("regions"))
