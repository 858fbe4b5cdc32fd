"""The index of patterns against comparing every text with every pattern."""

import random
import re

from pyspark.sql import functions as F

from blockyard.functions.globs import glob_to_regex
from blockyard.operators import pattern_index as pi
from blockyard.operators import requests as rq


def urls(n, seed=1):
    rng = random.Random(seed)
    word = lambda: rng.choice(["ad", "ads", "Banner", "img", "x1", "track%20", "video", "a", "cdn-7", "é"])
    return [f"https://{word()}.{rng.choice(['alpha', 'beta', 'gamma'])}.example/{'/'.join(word() for _ in range(rng.randrange(4)))}{rng.choice(['', '?q=' + word(), '.js'])}" for _ in range(n)]


def globs(n, seed=2):
    rng = random.Random(seed)
    part = lambda: rng.choice(["ad", "Ads", "banner", "/img/", ".", "alpha.example", "https://", "x", "?", "??", "q=", "video", ".JS", "a", "é", "(", "zzz"])
    out = ["*", "<all_urls>", "?*", "", "*/*", "*://*.alpha.example/*"]
    return out + ["".join(rng.choice([part(), "*" + part(), part() + "*"]) for _ in range(rng.randrange(1, 4))) for _ in range(n)]


def glob_matches(glob, url):
    if glob == "<all_urls>":
        return True
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob)
    return re.fullmatch(body, url, re.I | re.S | re.A) is not None


def test_globs_against_every_pair(spark):
    texts, patterns = sorted(set(urls(200))), sorted(set(globs(150)))
    t = spark.createDataFrame([(u,) for u in texts] + [(None,)], "url string")
    p = spark.createDataFrame([(g,) for g in patterns] + [(None,)], "glob string").select("glob", glob_to_regex(F.col("glob")).alias("regex"), pi.glob_shape(F.col("glob")).alias("shape"))
    for per_task in (50_000, 7):
        got = [(r["url"], r["glob"]) for r in pi.matching_pairs(t, p, "url", per_task=per_task).collect()]
        assert len(got) == len(set(got)) and set(got) == {(u, g) for u in texts for g in patterns if glob_matches(g, u)}


def test_filters_wait_under_their_rarest_key_and_hot_keys_are_dealt(spark):
    """'common' is in every URL; a filter with a rarer word waits under that, one without is met by salted tasks."""
    t = spark.createDataFrame([(i, f"https://h{i}.example/common/{'rare' if i % 50 == 0 else 'x'}/{i}") for i in range(2000)], "id long, url string")
    lines = [(0, True, "/common/rare/*"), (1, True, "/common/*"), (2, True, "ommo")]
    filters, rejected = rq.parse_filters(spark.createDataFrame(lines, "pos int, custom boolean, line string"))
    assert rejected.count() == 0
    keys = {r["pos"]: set(r["k"]) for r in filters.select("pos", pi.shape_keys(F.col("shape")).alias("k")).collect()}
    assert keys == {0: {"wcommon", "wrare"}, 1: {"wcommon"}, 2: {"3omm", "3mmo"}}
    pairs = pi.matching_pairs(t, filters.select("pos", "regex", "shape"), "url", per_task=100)
    assert pairs.groupBy("pos").count().orderBy("pos").collect() == [(0, 40), (1, 2000), (2, 2000)]
    join = pairs.drop("url")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in join and "Cartesian" not in join
    salts = t.select(F.pmod(F.xxhash64("id", "url"), F.lit(21)).alias("s")).groupBy("s").count().agg(F.max("count"), F.percentile("count", 0.5)).first()
    assert salts[0] < 3 * salts[1]


def test_many_filters_without_a_word(spark):
    """Thousands of filters that hold no whole word, in any number."""
    lines = [(i, False, f"q{i}z") for i in range(2501)]
    filters, _ = rq.parse_filters(spark.createDataFrame(lines, "pos int, custom boolean, line string"))
    rows = [(i, f"https://a.example/xq{i * 100}zx", "https://b.example/", "script") for i in range(30)]
    got = rq.match_filters(spark.createDataFrame(rows, "request_id long, url string, page_url string, type string"), filters).collect()
    assert {r["request_id"]: r["pos"] for r in got} == {i: i * 100 for i in range(26)}


def test_plans_without_nested_loops(spark):
    asked = spark.createDataFrame([(i, f"https://cdn.example/{i}.js", "https://a.example/", "script") for i in range(5)], "request_id long, url string, page_url string, type string")
    match = spark.createDataFrame([(0, "one", True, "*a.example*"), (1, "all", True, "*")], "set_pos int, name string, enabled boolean, pattern string")
    to = spark.createDataFrame([(1, 0, "*/3.js", "https://x.example/$1")], "set_pos int, pos int, from string, to string")
    block = spark.createDataFrame([(0, 0, "*2.js")], "set_pos int, pos int, pattern string")
    filters, _ = rq.parse_filters(spark.createDataFrame([(0, True, "4.js|")], "pos int, custom boolean, line string"))
    out = rq.decide_requests(asked, match, to, block, filters)
    assert {r["request_id"]: (r["decision"], r["target"], r["decided_by"]) for r in out.collect()} == {
        0: ("allow", None, None), 1: ("allow", None, None), 2: ("block", None, "one"), 3: ("redirect", "https://x.example/https://cdn.example", "all"), 4: ("block", None, "filters")}
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_payload_has_lists_first_and_options(spark):
    pages = spark.createDataFrame([("https://a.example/p",), ("https://b.example/",), ("https://c.example/",)], "page_url string")
    match = spark.createDataFrame([(0, "one", True, "*a.example*"), (2, "two", True, "*example/*"), (3, "off", False, "*")], "set_pos int, name string, enabled boolean, pattern string")
    css = spark.createDataFrame([(0, ".x{}", None, {"k": "v"}), (2, None, "run()", None)], "set_pos int, css string, js string, options map<string,string>")
    cosmetics = rq.parse_cosmetics(spark.createDataFrame([(0, False, "##.ad"), (1, True, "a.example##.nag")], "pos int, custom boolean, line string"))
    got = {r["page_url"]: r for r in rq.rule_payload(pages, match, css, cosmetics, spark.createDataFrame([("c.example",)], "domain string")).collect()}
    first = got["https://a.example/p"]
    assert first["sets"] == "adblock,one,two" and [tuple(p)[1:] for p in first["payload"]] == [(".nag,\n.ad { display: none !important; }", "", "", {}), (".x{}", "", "", {"k": "v"}), ("", "run()", "", {})]
    assert got["https://b.example/"]["sets"] == "adblock,two" and got["https://c.example/"]["sets"] == "two"
