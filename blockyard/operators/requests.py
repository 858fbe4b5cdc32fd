"""Request decisions: rule sets, filter lists, allowlists, and what follows from them.

Rule sets and filter lists may be long: filters anchored at a domain meet requests by host suffix, all other patterns by
the key of their literal text that fewest requests have (``pattern_index``), so no request meets every pattern.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.globs import fill_template, glob_to_regex
from ..functions.urls import host, host_suffixes
from ..sources.shared import materialise
from .pattern_index import EDGE, GAP, folded, glob_shape, matching_pairs


def match_rule_sets(pages: DataFrame, rule_match: DataFrame) -> DataFrame:
    """(page_url, set_pos, name) of enabled rule sets with a pattern that covers the page URL."""
    rules = rule_match.filter("enabled").select("set_pos", "name", glob_to_regex(F.col("pattern")).alias("regex"), glob_shape(F.col("pattern")).alias("shape"))
    return matching_pairs(pages.select("page_url").distinct(), rules, "page_url").select("page_url", "set_pos", "name").distinct()


def decide_requests(requests: DataFrame, rule_match: DataFrame, rule_redirect: DataFrame, rule_block: DataFrame, filters: DataFrame | None = None, allowlist: DataFrame | None = None) -> DataFrame:
    """Adds decision (redirect, block, allow), target and decided_by.

    Of the sets that match the page, in order: redirects whose target is neither empty nor the request itself, then
    blocks; the first hit wins. Then filter lists decide, unless the page is on the allowlist.
    """
    asked = requests.withColumn("page_url", F.coalesce("page_url", "url"))
    asked, every = _pairs(asked), asked
    sets = match_rule_sets(asked, rule_match)
    met = asked.select("request_id", "page_url").join(sets, "page_url")
    redirect = rule_redirect.select("set_pos", F.lit(0).alias("kind"), "pos", F.col("from").alias("glob"), "to")
    block = rule_block.select("set_pos", F.lit(1).alias("kind"), "pos", F.col("pattern").alias("glob"), F.lit(None).cast("string").alias("to"))
    rules = redirect.unionByName(block).withColumns({"regex": glob_to_regex(F.col("glob")), "shape": glob_shape(F.col("glob"))}).drop("glob")
    hits = matching_pairs(asked.select("request_id", "url"), rules, "url").join(met, ["request_id", "set_pos"])
    target = F.when(F.col("kind") == 0, fill_template(F.col("to"), F.col("url"), F.col("regex")))
    hits = hits.withColumn("target", target).filter((F.col("kind") == 1) | ((F.col("target") != "") & (F.col("target") != F.col("url"))))
    decision = F.when(F.col("kind") == 0, "redirect").otherwise("block")
    first = hits.select("request_id", "name", "target", decision.alias("decision"), F.struct("set_pos", "kind", "pos").alias("order"))
    first = first.groupBy("request_id").agg(F.min_by(F.struct("decision", "target", "name"), "order").alias("hit"))
    out = asked.join(first, "request_id", "left")
    if filters is not None:
        blocked = match_filters(asked, filters).filter("blocked")
        if allowlist is not None:
            blocked = blocked.join(allowlisted(asked, allowlist).select("request_id"), "request_id", "left_anti")
        out = out.join(blocked.select("request_id", F.lit(True).alias("listed")), "request_id", "left")
    else:
        out = out.withColumn("listed", F.lit(None).cast("boolean"))
    decision = F.coalesce("hit.decision", F.when(F.col("listed"), "block"), F.lit("allow"))
    told = out.withColumns({"decision": decision, "target": F.col("hit.target"), "decided_by": F.coalesce("hit.name", F.when(F.col("listed"), "filters"))})
    keys = ("page_url", "url", "type")
    told = told.select(*(F.col(k).alias(f"_{k}") for k in keys), "decision", "target", "decided_by")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return every.join(told, same, "left").drop(*(f"_{k}" for k in keys))


def _pairs(asked: DataFrame) -> DataFrame:
    """The distinct requests of a log, under ids of their own: what is asked often is decided once. Written, for several steps read it."""
    # Rows are short and patterns cost much time each, so partitions are not merged by their bytes.
    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = asked.select("page_url", "url", "type").repartition(parts, "page_url", "url", "type").distinct()
    return materialise(distinct.withColumn("request_id", F.monotonically_increasing_id()), "requests")


def allowlisted(requests: DataFrame, domains: DataFrame) -> DataFrame:
    """Requests whose page host is one of the domains or below one."""
    each = requests.withColumn("_suffix", F.explode(host_suffixes(F.regexp_replace(host(F.col("page_url")), r":\d+$", ""))))
    return each.join(domains.select(F.col("domain").alias("_suffix")).distinct(), "_suffix", "left_semi").drop("_suffix").dropDuplicates(["request_id"])


def parse_filters(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(filters, rejected) of lines (pos, custom, line).

    Supported: plain text, *, ^, |, ||domain, @@ and the options script, image, third-party and domain=. Lines with
    other options and cosmetic lines with scriptlets go to rejected; comments and empty lines to neither.
    """
    line = lines.withColumn("line", F.trim("line")).filter("line != '' and line not like '!%' and line not like '[%'")
    cosmetic = line.filter(F.col("line").contains("##") | F.col("line").contains("#@#") | F.col("line").contains("#?#"))
    net = line.join(cosmetic.select("pos", "custom"), ["pos", "custom"], "left_anti")
    exception = F.col("line").startswith("@@")
    body = F.when(exception, F.substring("line", 3, 1 << 20)).otherwise(F.col("line"))
    options = F.when(body.rlike(r"\$[A-Za-z0-9,=.|~_-]+$"), F.regexp_extract(body, r"\$([^$]*)$", 1)).otherwise("")
    pattern = F.when(options != "", F.regexp_replace(body, r"\$[^$]*$", "")).otherwise(body)
    net = net.select("pos", "custom", "line", exception.alias("exception"), pattern.alias("pattern"), F.filter(F.split(options, ","), lambda o: o != "").alias("options"))
    known = F.forall("options", lambda o: o.rlike(r"^(script|image|third-party|domain=.+)$")) & ~F.col("pattern").rlike(r"^/.*/$")
    domain = F.regexp_extract("pattern", r"^\|\|([a-z0-9.-]+)", 1)
    regex = F.regexp_replace(F.regexp_replace("pattern", r"^\|\|", ""), r"([.+?${}()\[\]\\])", r"\\$1")
    tail = F.regexp_replace(F.regexp_replace(F.regexp_replace(regex, r"\*", ".*"), r"\^", r"(?:[^A-Za-z0-9_.%-]|\\z)"), r"\|$", r"\\z")
    anchored = F.when(domain != "", F.concat(F.lit(r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?"), tail)).when(F.col("pattern").startswith("|"), F.concat(F.lit("(?i)^"), F.regexp_replace(tail, r"^\|", ""))).otherwise(F.concat(F.lit("(?i)"), tail))
    # A separator is one character that no word has, or the end; an open start or end may go on with anything.
    open_start = F.when(F.col("pattern").startswith("|"), F.regexp_replace("pattern", r"^\|", "")).otherwise(F.concat(F.lit(GAP), F.col("pattern")))
    open_end = F.when(open_start.endswith("|"), F.regexp_replace(open_start, r"\|$", "")).otherwise(F.concat(open_start, F.lit(GAP)))
    shape = F.regexp_replace(F.regexp_replace(folded(open_end), r"\*", GAP), r"\^", EDGE)
    types = F.filter("options", lambda o: o.isin("script", "image"))
    pages = F.flatten(F.transform(F.filter("options", lambda o: o.startswith("domain=")), lambda o: F.split(F.substring_index(o, "=", -1), r"\|")))
    filters = net.filter(known).select("pos", "custom", "exception", "pattern", F.when(domain != "", domain).alias("domain"), anchored.alias("regex"), shape.alias("shape"), types.alias("types"), F.array_contains("options", "third-party").alias("third_party"), pages.alias("pages"))
    return filters, net.filter(~known).select("pos", "custom", "line")


def match_filters(requests: DataFrame, filters: DataFrame) -> DataFrame:
    """(request_id, blocked, pos): the deciding filter of each request that any filter matches; exceptions win within custom or listed filters, custom ones come first.

    Top documents are never matched. A filter of a domain waits under it, any other under the rarest key of its literal
    text among all requests; the regular expression has the last word.
    """
    asked = requests.filter("type != 'document'").select("request_id", "url", "type", F.regexp_replace(host(F.col("url")), r":\d+$", "").alias("host"), F.regexp_replace(host(F.col("page_url")), r":\d+$", "").alias("page_host"))
    columns = ["pos", "custom", "exception", "regex", "types", "third_party", "pages"]
    by_domain = filters.filter("domain is not null").withColumn("key", F.col("domain"))
    by_host = asked.withColumn("key", F.explode(host_suffixes(F.col("host")))).join(by_domain.select("key", *columns), "key").drop("key").filter(F.expr("url rlike regex"))
    loose = filters.filter("domain is null").select("shape", *columns).withColumnRenamed("types", "kinds").withColumnRenamed("pages", "on_pages")
    by_key = matching_pairs(asked, loose, "url").withColumnRenamed("kinds", "types").withColumnRenamed("on_pages", "pages")
    met = by_host.unionByName(by_key)
    kind = (F.size("types") == 0) | F.array_contains("types", F.col("type"))
    far = ~F.col("third_party") | ~(F.col("host").eqNullSafe(F.col("page_host")) | F.expr("host like concat('%.', page_host)") | F.expr("page_host like concat('%.', host)"))
    here = (F.size("pages") == 0) | F.arrays_overlap("pages", host_suffixes(F.col("page_host")))
    good = met.filter(kind & far & here)
    return good.groupBy("request_id").agg(F.min_by(F.struct((~F.col("exception")).alias("blocked"), "pos"), F.struct((~F.col("custom")).cast("int"), (~F.col("exception")).cast("int"), F.col("pos"))).alias("f")).select("request_id", "f.blocked", "f.pos")


def parse_cosmetics(lines: DataFrame) -> DataFrame:
    """(pos, custom, domain, selector, exception) of element-hiding lines; domain is '' where a line is for all pages.

    ``#@#`` lines and domains after ``~`` are exceptions: they take the selector away from their pages.
    """
    hiding = lines.filter(F.col("line").rlike("#@?#") & ~F.col("line").contains("##+"))
    sides = F.split(F.trim("line"), "#@?#", 2)
    except_line = F.col("line").contains("#@#")
    named = F.split(sides[0], ",")
    # A line that names only exceptions is for all other pages.
    domains = F.when(F.forall(named, lambda d: d.startswith("~")), F.array_append(named, F.lit(""))).otherwise(named)
    rows = hiding.select("pos", "custom", F.explode(domains).alias("domain"), sides[1].alias("selector"), except_line.alias("whole"))
    return rows.filter("selector != ''").select("pos", "custom", F.regexp_replace("domain", "^~", "").alias("domain"), "selector", (F.col("whole") | F.col("domain").startswith("~")).alias("exception"))


def cosmetic_selectors(pages: DataFrame, cosmetics: DataFrame, allowlist: DataFrame | None = None) -> DataFrame:
    """(page_id, selectors): element-hiding selectors of the page's host and its parents, custom ones first, each once.

    A selector with an exception for the page is left out; pages of ``allowlist`` (domain) have none at all.
    """
    if allowlist is not None:
        named = pages.select(F.col("page_id").alias("request_id"), F.col("url").alias("page_url"))
        pages = pages.join(allowlisted(named, allowlist).select(F.col("request_id").alias("page_id")), "page_id", "left_anti")
    hosts = F.array_append(host_suffixes(F.regexp_replace(host(F.col("url")), r":\d+$", "")), F.lit(""))
    met = pages.select("page_id", F.explode(hosts).alias("domain")).join(cosmetics, "domain")
    each = met.groupBy("page_id", "selector").agg(F.min(F.struct((~F.col("custom")).cast("int"), "pos")).alias("o"), F.bool_or("exception").alias("off"))
    once = each.filter("not off")
    return once.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "selector"))), lambda x: x["selector"]).alias("selectors"))


HIDDEN = "display: none !important;"


def rule_payload(pages: DataFrame, rule_match: DataFrame, rule_css: DataFrame, cosmetics: DataFrame | None = None, allowlist: DataFrame | None = None) -> DataFrame:
    """(page_url, sets, css, payload): what a page gets at its start; pages without any have no row.

    payload is an array of (name, css, js, main_js, options) of the matching sets in file order, before them one named
    ``adblock`` with the element-hiding selectors of the filter lists, unless the page is on ``allowlist``; sets and css
    tell its names and its css joined. ``rule_css`` has set_pos and css, and may have js, main_js and options (a map).
    """
    has = lambda c, other: F.coalesce(F.col(c), other) if c in rule_css.columns else other
    none = F.lit("")
    parts = rule_css.select("set_pos", has("css", none).alias("css"), has("js", none).alias("js"), has("main_js", none).alias("main_js"), has("options", F.create_map().cast("map<string,string>")).alias("options"))
    met = match_rule_sets(pages, rule_match).join(parts, "set_pos", "left")
    told = lambda pos, name, css, js, main, options: F.struct(pos.cast("int").alias("pos"), name.alias("name"), css.alias("css"), js.alias("js"), main.alias("main_js"), options.alias("options"))
    empty = F.create_map().cast("map<string,string>")
    rows = met.select("page_url", told(F.col("set_pos"), F.col("name"), F.coalesce("css", none), F.coalesce("js", none), F.coalesce("main_js", none), F.coalesce("options", empty)).alias("p"))
    if cosmetics is not None:
        urls = pages.select(F.col("page_url").alias("page_id"), F.col("page_url").alias("url")).distinct()
        hiding = cosmetic_selectors(urls, cosmetics, allowlist).filter(F.size("selectors") > 0)
        style = F.concat(F.array_join("selectors", ",\n"), F.lit(f" {{ {HIDDEN} }}"))
        rows = rows.unionByName(hiding.select(F.col("page_id").alias("page_url"), told(F.lit(-1), F.lit("adblock"), style, none, none, empty).alias("p")))
    # Maps have no order, so places are sorted, and each part found again under its place; the sets of a page are few.
    held = rows.groupBy("page_url").agg(F.map_from_entries(F.collect_list(F.struct("p.pos", "p"))).alias("by"))
    parts_of = F.transform(F.array_sort(F.map_keys("by")), lambda k: F.element_at("by", k))
    out = held.select("page_url", F.transform(parts_of, lambda x: x.dropFields("pos")).alias("payload"))
    return out.select("page_url", F.array_join(F.transform("payload", lambda x: x["name"]), ",").alias("sets"), F.array_join(F.filter(F.transform("payload", lambda x: x["css"]), lambda c: c != ""), "\n").alias("css"), "payload")


def filter_hits(decisions: DataFrame) -> DataFrame:
    """(decided_by, blocked, redirected) by rule set or list; requests that nothing decided under '-'."""
    by = F.coalesce("decided_by", F.lit("-"))
    count = lambda d: F.sum((F.col("decision") == d).cast("long"))
    return decisions.groupBy(by.alias("decided_by")).agg(F.count("*").alias("requests"), count("block").alias("blocked"), count("redirect").alias("redirected"))


def decision_totals(decisions: DataFrame) -> DataFrame:
    """One row: requests checked, blocked and redirected."""
    count = lambda d: F.sum((F.col("decision") == d).cast("long"))
    return decisions.agg(F.count("*").alias("checked"), count("block").alias("blocked"), count("redirect").alias("redirected"))


def blocked_per_page(decisions: DataFrame) -> DataFrame:
    """(page_url, checked, blocked)."""
    return decisions.groupBy("page_url").agg(F.count("*").alias("checked"), F.sum((F.col("decision") == "block").cast("long")).alias("blocked"))


def recent_messages(messages: DataFrame, level: str = "all", pattern: str | None = None, limit: int = 100, kept: int = 400) -> DataFrame:
    """The last ``limit`` of each tab's last ``kept`` console messages (tab_id, ts, message_id, level, message), newest first as place 1.

    ``level`` goes by its first letter, and ``pattern`` disregards case.
    """
    by = Window.partitionBy("tab_id").orderBy(F.desc("ts"), F.desc("message_id"))
    held = messages.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= kept)
    if level != "all":
        held = held.filter(F.lower("level").startswith(level[0]))
    if pattern:
        held = held.filter(F.col("message").rlike(f"(?i){pattern}"))
    return held.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= limit)


def recent_requests(requests: DataFrame, pattern: str, limit: int = 100, kept: int = 400) -> DataFrame:
    """The last ``limit`` of each tab's last ``kept`` requests whose URL matches, newest first as place 1."""
    by = Window.partitionBy("tab_id").orderBy(F.desc("ts"), F.desc("request_id"))
    held = requests.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= kept).filter(F.col("url").rlike(pattern))
    return held.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= limit)


def document_changes(navigations: DataFrame) -> DataFrame:
    """Navigations (tab_id, ts, nav_id, url, title) that bring a new document: path without /page/N, or title, differs from the one before."""
    by = Window.partitionBy("tab_id").orderBy("ts", "nav_id")
    bare = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"/page/\d+/?$", "/")
    seen = navigations.withColumn("_path", bare)
    same = F.col("_path").eqNullSafe(F.lag("_path").over(by)) & F.col("title").eqNullSafe(F.lag("title").over(by))
    return seen.withColumn("changed", ~(same & (F.row_number().over(by) > 1))).filter("changed").drop("_path", "changed")


def tab_counters(events: DataFrame) -> DataFrame:
    """(tab_id, nav_no, requests, blocked) of events (tab_id, ts, event_id, navigation, blocked): counters begin anew with each navigation."""
    by = Window.partitionBy("tab_id").orderBy("ts", "event_id")
    numbered = events.withColumn("nav_no", F.sum(F.col("navigation").cast("int")).over(by))
    return numbered.filter("not navigation").groupBy("tab_id", "nav_no").agg(F.count("*").alias("requests"), F.sum(F.col("blocked").cast("long")).alias("blocked"))


def blocked_updates(events: DataFrame, every: str = "600 milliseconds") -> DataFrame:
    """(tab_id, window_start, blocked): one update per tab and window that has blocked requests; works on streams, too."""
    cut = events.filter("blocked").groupBy("tab_id", F.window("ts", every)).agg(F.count("*").alias("blocked"))
    return cut.select("tab_id", F.col("window.start").alias("window_start"), "blocked")
