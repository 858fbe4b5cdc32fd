"""Label runs: ranking, flags, reviews, summaries and comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialise

COST_PER_MILLION = 0.042  # fixed value: price of a million input tokens


def rank_probabilities(rows: DataFrame) -> DataFrame:
    """Adds choice, confidence, margin and top (five of type and p) for the map column probabilities; ties by name.

    The margin of a single class is 1. Without any class (null or empty map) choice, confidence and margin are null.
    """
    entries = F.transform(F.map_entries("probabilities"), lambda e: F.struct((-e["value"]).alias("by"), e["key"].alias("type"), F.round(e["value"], 3).alias("p")))
    ranked = rows.withColumn("_r", F.array_sort(entries))
    first, second = F.get("_r", F.lit(0)), F.get("_r", F.lit(1))
    gap = F.when(F.size("_r") > 1, F.round(second["by"] - first["by"], 3)).when(F.size("_r") == 1, 1.0)
    return ranked.withColumns({"choice": first["type"], "confidence": first["p"], "margin": gap, "top": F.transform(F.slice("_r", 1, 5), lambda x: F.struct(x["type"].alias("type"), x["p"].alias("p")))}).drop("_r")


def flag_labels(labels: DataFrame, below: float = 0.5, tie: float = 0.1) -> DataFrame:
    """Adds flagged: too unsure, or the first two too close."""
    return labels.withColumn("flagged", (F.col("confidence") < below) | (F.col("margin") < tie))


def apply_verdicts(labels: DataFrame, judgements: DataFrame) -> DataFrame:
    """Adds review and final; judgements (page_id, idx, verdict) say ok, either, unsure or wrong:<type>."""
    out = labels.join(judgements.select("page_id", "idx", F.col("verdict").alias("review")), ["page_id", "idx"], "left")
    wrong = F.col("review").startswith("wrong:")
    return out.withColumn("final", F.when(wrong, F.substring_index("review", ":", -1)).otherwise(F.col("choice"))).withColumn("review", F.when(wrong, "wrong").otherwise(F.col("review")))


def run_stats(labels: DataFrame, below: float = 0.5) -> DataFrame:
    """One row: n, flagged, min, p25, median, p75 and max of confidence, tokens and cost.

    The labels are read once: everything follows from the counts and tokens of equal confidences.
    """
    counted = materialise(labels.groupBy("confidence").agg(F.count("*").alias("c"), F.sum("input_tokens").alias("tokens")), "confidences")
    c = F.col("confidence")
    sums = counted.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.sum(F.when(c < below, F.col("c")).when(c.isNotNull(), 0)).alias("flagged"), F.min(c).alias("min"), F.max(c).alias("max"),
        F.sum("tokens").alias("tokens"), F.round(F.sum("tokens") * COST_PER_MILLION / 1e6, 6).alias("cost"),
    )
    ranks = quantiles_of_counts(counted, "confidence", {"p25": 0.25, "median": 0.5, "p75": 0.75})
    return sums.withColumn("_one", F.lit(1)).join(ranks.withColumn("_one", F.lit(1)), "_one").drop("_one")  # a row each


def latency_stats(labels: DataFrame) -> DataFrame:
    """One row: median and p90 of the column ms."""
    return ranked_quantiles(labels, "ms", {"median": 0.5, "p90": 0.9})


def ranked_quantiles(values: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """One row of exact rank quantiles of a large column, which is read once: equal values are counted and the counts written."""
    return quantiles_of_counts(materialise(values.groupBy(column).agg(F.count("*").alias("c")), "counted"), column, shares)


def quantiles_of_counts(counted: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """``ranked_quantiles`` of a stored table of values and how many there are of each (``c``).

    A sketch cuts the values into up to 1,000 ranges of about equal size, whose sums fit in one row each, and ranks are
    summed up within a range.
    """
    known = counted.filter(F.col(column).isNotNull())
    total, cuts = known.agg(F.sum("c"), F.percentile_approx(column, [i / 1000 for i in range(1, 1000)], 10_000)).first()
    total, cuts = total or 0, sorted(set(cuts or []))
    spread = known.withColumn("_g", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x <= F.col(column))) if cuts else F.lit(0))
    groups = spread.groupBy("_g").agg(F.sum("c").alias("w"))
    before = groups.select("_g", (F.sum("w").over(Window.orderBy("_g")) - F.col("w")).alias("_before"))
    placed = spread.join(F.broadcast(before), "_g").withColumn("upto", F.sum("c").over(Window.partitionBy("_g").orderBy(column)) + F.col("_before"))
    return placed.agg(*(F.min(F.when(F.col("upto") > min(total - 1, int(p * total)), F.col(column))).alias(name) for name, p in shares.items()))


def label_summary(labels: DataFrame) -> DataFrame:
    """(choice, n, flagged, mean_confidence) histogram by type."""
    return labels.groupBy("choice").agg(F.count("*").alias("n"), F.sum(F.col("flagged").cast("long")).alias("flagged"), F.round(F.avg("confidence"), 3).alias("mean_confidence"))


def label_totals(labels: DataFrame, below: float = 0.5, tie: float = 0.1) -> DataFrame:
    """One row: pages, regions, and how many are unsure, tied, or either."""
    unsure, tied = F.col("confidence") < below, F.col("margin") < tie
    count = lambda c: F.sum(c.cast("long"))
    return labels.agg(F.count_distinct("page_id").alias("pages"), F.count("*").alias("regions"), count(unsure).alias("low_confidence"), count(tied).alias("ties"), count(unsure | tied).alias("either"))


def application_scores(pages: DataFrame) -> DataFrame:
    """Adds disagrees to pages (page_id, tier, application): a contained page that seems no application, or a relayout one that does. A page without score agrees."""
    odd = ((F.col("tier") == "contained") & (F.col("application") < 0.5)) | ((F.col("tier") == "relayout") & (F.col("application") > 0.5))
    return pages.withColumn("disagrees", F.coalesce(odd, F.lit(False)))


def unused_types(labels: DataFrame, types: DataFrame) -> DataFrame:
    return types.select("type").join(labels.select(F.col("choice").alias("type")).distinct(), "type", "left_anti")


def within_types(rows: DataFrame, types: Sequence[str]) -> DataFrame:
    """The map column probabilities limited to the listed types, scaled to a sum of 1.

    Rank the result anew. A row whose types are all unlisted, or have no probability, gets an empty map; null stays null.
    """
    listed = F.array(*map(F.lit, types)).cast("array<string>")
    total = F.aggregate(F.map_values("_kept"), F.lit(0.0), lambda a, x: a + x)
    kept = rows.withColumn("_kept", F.map_filter("probabilities", lambda k, v: F.array_contains(listed, k) & (v > 0)))
    return kept.withColumn("probabilities", F.transform_values("_kept", lambda k, v: v / total)).drop("_kept")


def list_use(labels: DataFrame, lists: DataFrame) -> DataFrame:
    """(list, types, used, labels, outside) of every list of types (list, type): how many types it has and how many of them a run chose, how many labels have a choice, and how many of these it does not know."""
    chosen = labels.filter("choice is not null").groupBy(F.col("choice").alias("type")).agg(F.count("*").alias("n"))
    total = chosen.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("labels")).scalar()
    known = lists.distinct().join(chosen, "type", "left").groupBy("list").agg(F.count("*").alias("types"), F.count("n").alias("used"), F.coalesce(F.sum("n"), F.lit(0)).alias("known"))
    return known.select("list", "types", "used", total.alias("labels"), (total - F.col("known")).alias("outside"))


def unlabelled(regions: DataFrame, labels: DataFrame) -> DataFrame:
    return regions.join(labels.select("page_id", "idx"), ["page_id", "idx"], "left_anti")


def confused_pairs(labels: DataFrame) -> DataFrame:
    """(a, b, n): unordered first two types of flagged rows."""
    pair = F.array_sort(F.array(F.col("top")[0]["type"], F.col("top")[1]["type"]))
    both = labels.filter(F.col("flagged") & (F.size("top") > 1)).select(pair.alias("p"))
    return both.groupBy(F.col("p")[0].alias("a"), F.col("p")[1].alias("b")).agg(F.count("*").alias("n"))


def _paired(before: DataFrame, after: DataFrame) -> DataFrame:
    """Runs (url, text, seq, choice, confidence) paired by url and the first 60 characters of text; the last row of a key, by seq, stands for it."""
    key = lambda run: run.withColumn("key", F.left("text", F.lit(60)))
    last = lambda run, p: key(run).groupBy("url", "key").agg(F.max_by("choice", "seq").alias(f"{p}_choice"), F.max_by("confidence", "seq").alias(f"{p}_conf"))
    return last(before, "a").join(last(after, "b"), ["url", "key"])


def compare_runs(before: DataFrame, after: DataFrame, below: float = 0.5) -> DataFrame:
    """One row on two paired runs: how many rows moved which way."""
    pairs = _paired(before, after)
    delta = F.col("b_conf") - F.col("a_conf")
    count = lambda c: F.sum(c.cast("long"))
    return pairs.agg(
        F.count("*").alias("paired"), F.round(F.avg(delta), 4).alias("mean_delta"), count(delta > 0.1).alias("up"), count(delta < -0.1).alias("down"),
        count(F.col("a_choice") != F.col("b_choice")).alias("relabelled"),
        count((F.col("a_conf") >= below) & (F.col("b_conf") < below)).alias("newly_flagged"), count((F.col("a_conf") < below) & (F.col("b_conf") >= below)).alias("unflagged"),
    )


def moved_labels(before: DataFrame, after: DataFrame, least: float = 0.15) -> DataFrame:
    """(kind, url, key, a_choice, a_conf, b_choice, b_conf, delta) of paired rows that lost or gained confidence, or were relabelled at a similar one; largest change of a kind first."""
    told = _paired(before, after).withColumn("delta", F.round(F.col("b_conf") - F.col("a_conf"), 3))
    kind = F.when(F.col("delta") < -least, "lost").when(F.col("delta") > least, "gained").when(F.col("a_choice") != F.col("b_choice"), "relabelled")
    return told.withColumn("kind", kind).filter("kind is not null").orderBy("kind", F.desc(F.abs("delta")), "url", "key")


def review_score(labels: DataFrame, judgements: DataFrame) -> DataFrame:
    """(flagged, judged, ok, either, wrong, unsure) of judged labels by flag."""
    met = labels.join(judgements.select("page_id", "idx", "verdict"), ["page_id", "idx"])
    kind = F.substring_index("verdict", ":", 1)
    return met.groupBy("flagged").agg(F.count("*").alias("judged"), *(F.sum((kind == k).cast("long")).alias(k) for k in ("ok", "either", "wrong", "unsure")))


def _judged(labels: DataFrame, judgements: DataFrame) -> DataFrame:
    met = labels.join(judgements.select("page_id", "idx", "verdict"), ["page_id", "idx"])
    return met.withColumn("kind", F.substring_index("verdict", ":", 1))


def _tally() -> list:
    return [F.sum((F.col("kind") == k).cast("long")).alias(k) for k in ("ok", "either", "wrong", "unsure")]


def review_totals(labels: DataFrame, judgements: DataFrame) -> DataFrame:
    """One row: judged, the verdicts, and the shares right, acceptable and wrong of those decided; null where none is."""
    sums = _judged(labels, judgements).agg(F.count("*").alias("judged"), *_tally())
    decided = F.nullif(F.col("ok") + F.col("either") + F.col("wrong"), F.lit(0))
    share = lambda c: F.round(c / decided, 3)
    return sums.withColumns({"right": share(F.col("ok")), "acceptable": share(F.col("ok") + F.col("either")), "wrong_share": share(F.col("wrong"))})


def review_by_type(labels: DataFrame, judgements: DataFrame) -> DataFrame:
    """(choice, judged, ok, either, wrong, unsure)."""
    return _judged(labels, judgements).groupBy("choice").agg(F.count("*").alias("judged"), *_tally())


def review_confusions(labels: DataFrame, judgements: DataFrame) -> DataFrame:
    """(choice, should, n) of labels judged wrong; should is ``?`` where the verdict names no type."""
    should = F.coalesce(F.get(F.split("verdict", ":"), F.lit(1)), F.lit("?"))
    return _judged(labels, judgements).filter("kind = 'wrong'").groupBy("choice", F.when(should == "", "?").otherwise(should).alias("should")).agg(F.count("*").alias("n"))


def unknown_judgements(judgements: DataFrame, labels: DataFrame) -> DataFrame:
    return judgements.join(labels.select("page_id", "idx"), ["page_id", "idx"], "left_anti")


def review_sample(labels: DataFrame, n: int, seed: int) -> DataFrame:
    """n unflagged labels, the same for the same seed: those of smallest hash."""
    order = F.md5(F.concat_ws(":", F.col("page_id").cast("string"), F.col("idx").cast("string"), F.lit(str(seed))))
    return labels.filter(~F.col("flagged")).orderBy(order, "page_id", "idx").limit(n)


def label_requests(regions: DataFrame) -> DataFrame:
    """(page_id, idx, text, before, after): a region with one line on each neighbour."""
    page = Window.partitionBy("page_id").orderBy("idx")
    brief = F.concat(F.col("tag"), F.lit(": "), F.left(F.regexp_replace("text", r"[ \n\t]+", " "), F.lit(80)))
    told = regions.withColumn("brief", brief)
    return told.select("page_id", "idx", "text", F.lag("brief").over(page).alias("before"), F.lead("brief").over(page).alias("after"))


def label_states(regions: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, idx, url, title, text, before, after): what a labelling model is told of a region; neighbours are named with their landmarks. Regions of unknown pages have null url and title."""
    page = Window.partitionBy("page_id").orderBy("idx")
    where = F.when(F.size("landmarks") > 0, F.concat(F.lit(" in "), F.array_join("landmarks", ">"))).otherwise("")
    brief = F.concat(F.col("tag"), where, F.lit(": "), F.translate(F.left("text", F.lit(80)), "\n", " "))
    told = regions.withColumn("brief", brief).withColumns({"before": F.lag("brief").over(page), "after": F.lead("brief").over(page)})
    return told.join(pages.select("page_id", "url", "title"), "page_id", "left").select("page_id", "idx", "url", "title", "text", "before", "after")


def page_summaries(regions: DataFrame) -> DataFrame:
    """(page_id, regions, summary): tag, landmarks, characters, links and controls of a page's regions in order."""
    where = F.when(F.size("landmarks") > 0, F.concat(F.lit("("), F.array_join("landmarks", ">"), F.lit(")"))).otherwise("")
    line = F.concat("tag", where, F.lit(" "), F.col("text_length"), F.lit("ch "), F.col("links"), F.lit("a "), F.col("controls"), F.lit("ctl"))
    held = F.array_sort(F.collect_list(F.struct("idx", line.alias("line"))))
    return regions.groupBy("page_id").agg(F.count("*").alias("regions"), F.array_join(F.transform(held, lambda x: x["line"]), "; ").alias("summary"))


def audit_hints(flags: DataFrame, labels: DataFrame, least: int = 5) -> DataFrame:
    """(flag, matches, sites, type, precision) of flags (page_id, idx, site, flag) set on at least ``least`` labelled regions."""
    met = flags.join(labels.select("page_id", "idx", "final"), ["page_id", "idx"])
    by_type = met.groupBy("flag", "final").agg(F.count("*").alias("c"))
    best = by_type.groupBy("flag").agg(F.sum("c").alias("matches"), F.min_by("final", F.struct(-F.col("c"), F.col("final"))).alias("type"), F.max("c").alias("top"))
    sites = met.select("flag", "site").distinct().groupBy("flag").agg(F.count("*").alias("sites"))
    return best.filter(F.col("matches") >= least).join(sites, "flag").select("flag", "matches", "sites", "type", F.round(F.col("top") / F.col("matches"), 3).alias("precision"))
