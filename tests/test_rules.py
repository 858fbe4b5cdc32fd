import numpy as np
import pytest
from pyspark.sql import functions as F

from blockyard.functions.lexicon import HINTS, TEXTS, flag_columns, flag_sql, set_flags
from blockyard.functions.text import fnv1a
from blockyard.operators import trees
from blockyard.operators.directory import derive_directory, with_selector
from blockyard.operators.rules import CORE, RuleSet
from blockyard.operators.vectors import NAMES, token_hash
from blockyard.plans.flagship import classify_pages, page_blocks

P = "Some prose that goes on, and on, for a while, so that it fills a line or two. " * 6
PAGES = "page_id long, url string, html string"
FILLER = f"<section><p>{P}</p><p>{P}</p></section>"


def page(inner, before=FILLER, after=FILLER):
    return f"<body><main>{before}{inner}{after}</main></body>"


# One case or more of each group: markup, text to look for, type and rule.
CASES = [
    (page('<iframe src="https://www.youtube.com/embed/x" width=640 height=360></iframe>'), "", "video", "frame-video"),
    (page('<iframe src="https://x.example/" width=640 height=360></iframe>'), "", "embed", "frame-embed"),
    (page("<pre>let a = 1; // with enough words that it is no fragment of what stands next to it</pre>"), "let a", "code", "pre-code"),
    (page("<table class=infobox><tr><th>Born<td>1900<tr><th>Died<td>1980, with enough words that it is no fragment of what stands next to it</table>"), "Born", "infobox", "table-infobox"),
    (page("<h1>Head of it</h1>", before=""), "Head of it", "title", "h1-title"),
    (page("<h2>Related stories</h2>"), "Related", "related", "h-related-head"),
    (page("<h3>A part</h3>"), "A part", "heading", "h-heading"),
    (page('<figure><img src=a width=300 height=200><figcaption>A caption with enough words that it is no fragment of what stands next to it.</figcaption></figure>'), "A caption", "image", "figure"),
    (page("<blockquote>To be or not to be, that is the question of it with enough words that it is no fragment of what stands next to it.</blockquote>"), "To be", "quote", "blockquote"),
    (page("<button data-mx-r='0,500,200,80'>Get started</button>"), "Get started", "cta", "control-cta"),
    (page("<form><label>Mail</label><input><button>Send</button></form>"), "Mail", "form", "control-form"),
    (page("<div class=breadcrumb><a href=/a>Home</a> <a href=/b>News</a></div>"), "Home", "breadcrumbs", "breadcrumbs"),
    (page("<div class=toc><a href=/a>One part</a><a href=/b>Another</a></div>"), "One part", "table_of_contents", "toc"),
    (f"<body><header><a href=/>Site</a> with enough words that it is no fragment of what stands next to it</header>{FILLER}</body>", "Site", "site_header", "header"),
    (f"<body>{FILLER}<footer><a href=/p>Contact us all</a> with enough words that it is no fragment of what stands next to it</footer></body>", "Contact us", "site_footer", "footer"),
    (page("<div class=comment-list>I think that this is a rather good point to make here with enough words that it is no fragment of what stands next to it</div>"), "I think", "comments", "hint-comments"),
    (page("<div class='ad-slot'>Buy this now, for it is cheap today and only today in our shop</div>", after=f"<section>{P}</section>"), "Buy this", "ad", "hint-ad"),
    (page("<div class=byline>By Jane Doe, 3 May 2024, somewhere in the north of it all today</div>"), "By Jane", "byline", "hint-byline"),
    (page("<div>Published on 3 May 2024 by a person of the staff, in the north of it all, once</div>"), "Published", "byline", "text-byline"),
    (page("<ol><li>Preheat the oven</li><li>Mix it all up in a bowl with enough words that it is no fragment of what stands next to it</li></ol>"), "Preheat", "steps", "hint-steps"),
    (page("<ul><li>first item of a list of some</li><li>second item of the same list with enough words that it is no fragment of what stands next to it</li></ul>"), "first item", "list", "list-ul"),
    (page(f"<p class=x>{P}</p>", before="", after=""), "Some prose", "text", "prose-p"),
    (page("<div data-mx-r='0,500,200,80'><b>Some words</b><i>alone here</i></div>"), "Some words", "heading", "short-heading"),
]


def test_every_group_decides(spark):
    df = spark.createDataFrame([(i, f"https://s{i}.example/x", c[0]) for i, c in enumerate(CASES)], PAGES)
    got = {}
    for r in classify_pages(df).select("page_id", "text", "type", "rule", "frame_host").collect():
        got.setdefault(r["page_id"], []).append(r)
    wrong = []
    for i, (_, text, kind, rule) in enumerate(CASES):
        rows = [r for r in got.get(i, []) if (text and text in r["text"]) or (not text and r["frame_host"])]
        if not any((r["type"], r["rule"]) == (kind, rule) for r in rows):
            wrong.append((i, text, kind, rule, [(r["text"][:30], r["type"], r["rule"]) for r in rows]))
    assert not wrong


def test_rules_are_total_and_replaceable(spark):
    assert len(CORE.rules) == 233 and len(CORE.names()) == 232
    own = RuleSet(CORE.rules).add("mine", "quote", lambda: F.col("text_length") > 5, before="frame-video").without("fallback")
    df = spark.createDataFrame([(1, "https://s.example/x", page("<h3>A longer part</h3>")), (2, "ftp://no/page", page("x"))], PAGES)
    rows = classify_pages(df, rules=own).collect()
    assert {r["rule"] for r in rows} == {"mine"} and {r["page_id"] for r in rows} == {1}


def test_flags(spark):
    assert len(HINTS) == 92 and len(TEXTS) == 41
    rows = [("ad-slot cookie-bar", "We use cookies"), ("header", "By Jane Doe"), ("", "Load more"), ("breadéad", "x"), ("vcard event-calendar feedback", "pronunciation")]
    df = spark.createDataFrame(rows, "hint string, text string").withColumns(flag_columns(F.col("hint"), F.lower("text"))).withColumn("set", set_flags())
    got = [set(r["set"]) for r in df.collect()]
    assert {"h:ad", "h:cookie", "x:cookie"} <= got[0] and {"h:header", "x:byline"} <= got[1]
    assert got[2] == {"x:pagination"} and "h:ad" in got[3]  # letters with accents are no letters here
    assert {"h:infobox", "h:contact", "h:calendar", "h:feedback", "x:dictionary"} <= got[4]
    assert df.filter(F.expr(flag_sql("h", "cookie"))).count() == 1


def test_vectors_trees_and_directory_decide(spark):
    pages = [(i, f"https://site{i % 3}.example/p{i}", page(f"<h3>Part {i}</h3><div class=byline>By Jane Doe and others of the staff, with enough words that it is no fragment of what follows</div>")) for i in range(12)]
    df = spark.createDataFrame(pages, PAGES)
    from blockyard.operators.vectors import vectorize

    rows = vectorize(classify_pages(df)).withColumn("label", F.when(F.col("t") == "h3", "title").otherwise(F.col("type")))
    first = rows.filter("t = 'h3'").first()
    v = dict(zip(NAMES, first["features"]))
    assert len(NAMES) == len(first["features"]) and v["tag:h3"] == 1 and v["rule:h-heading"] == 1 and v["heur:heading"] == 1 and v["lm:main"] == 1
    assert v["n:len"] == first["text_length"] and v["b:inMain"] == 1 and v["b:inNav"] == 0
    assert abs(sum(v[f"w:{i}"] for i in range(256)) - 1) < 1e-6 and v[f"w:{token_hash('part') % 256}"] > 0
    assert spark.range(1).select(fnv1a(F.lit("naïve"))).first()[0] == token_hash("naïve")
    byline = rows.filter("rule = 'hint-byline'").first()
    assert dict(zip(NAMES, byline["features"]))["h:byline"] == 1
    model = trees.train(rows, "label", len(NAMES), trees.Options(rounds=2, depth=2, min_leaf=1, rate=1.0, row_share=1.0))
    calls = classify_pages(df, model=model)
    assert {r["stack_type"] for r in calls.filter("t = 'h3'").collect()} == {"title"} and calls.filter("source = 'trees'").count() > 0
    directory = derive_directory(with_selector(rows).withColumn("final", F.when(F.col("t") == "h3", "cta").otherwise(F.col("type"))))
    sourced = classify_pages(df, directory, model).filter("t = 'h3'").select("stack_type", "source").distinct().collect()
    assert [tuple(r) for r in sourced] == [("cta", "directory")]


@pytest.mark.parametrize("few", [True, False])
def test_page_gate(spark, few):
    df = spark.createDataFrame([(1, "https://s.example/x", "<p>one</p>" if few else page(f"<h1>T</h1><section>{P}</section><h2>U</h2><section>{P}</section>"))], PAGES)
    row = page_blocks(df).first()
    assert row["tier"] == ("contained" if few else "relayout") and row["total"] == row["keep"] + row["demote"] + row["drop"]
    assert np.isclose(row["content_share"], row["kept_chars"] / max(row["chars"], 1), atol=1e-3)


def test_lines_of_code_are_told_by_their_own_case(spark):
    """Headings of a list are no code for beginning with a word that code begins with."""
    inner = "<div>{}</div>"
    said = ["Class sizes here<br>Return policy here<br>Import duty here", "class Sizes {{<br>return policy;<br>import duty here"]
    rows = [(i, f"https://a.example/{i}", page(inner.format(t))) for i, t in enumerate(said)]
    got = {r["page_id"]: r["rule"] for r in classify_pages(spark.createDataFrame(rows, PAGES)).filter("lower(text) like '%policy%'").collect()}
    assert got[0] != "code-shape" and got[1] == "code-shape"


def test_a_frame_is_media_whatever_the_tag(spark):
    from blockyard.operators.regions import has_frame, structural_block

    rows = spark.createDataFrame([("div", None), ("div", "player.example"), ("h2", "player.example"), ("iframe", None)], "tag string, frame_host string")
    zero = {c: F.lit(0) for c in ("text_length", "links", "images", "headings", "controls", "repeats", "paragraphs")}
    rows = rows.withColumns(zero | {"link_ratio": F.lit(0.0)})
    assert [r[0] for r in rows.select(structural_block(has_frame(rows))).collect()] == ["empty", "media", "media", "media"]


def test_the_learned_stack_uses_all_three(spark, sf_dir):
    from blockyard.plans.flagship import count_blocks, learned_stack

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    calls, directory, model = learned_stack(pages, F.pmod("page_id", F.lit(2)) == 0, trees.Options(rounds=2, depth=2, rate=0.4))
    out = count_blocks(calls).agg(*(F.sum(c).alias(c) for c in ("total", "from_rules", "from_trees", "from_directory"))).first()
    assert out["total"] == out["from_rules"] + out["from_trees"] + out["from_directory"] > 100 and out["from_directory"] > 0 and out["from_trees"] > 0
    assert model.names == NAMES and directory.count() > 5 and calls.filter("page_id % 2 = 0").count() == 0


def test_types_by_column_and_sets_without_rules(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (4, "d"), (None, "e")], "n int, said string")
    own = RuleSet().add("told", F.col("said"), lambda: F.col("n") <= 2).add("made", "concat(said, '!')", lambda: F.col("n") == 3).add("plain", "text", lambda: F.col("n") >= 3)
    assert sorted((r["said"] or "", r["type"], r["rule"]) for r in own.classify(rows).collect()) == [("", None, "told"), ("a", "a", "told"), ("c", "c!", "made"), ("d", "text", "plain"), ("e", "unclear", "none")]
    plain = RuleSet().add("plain", "text", lambda: F.col("n") == 1)
    assert {r["type"] for r in plain.classify(rows).collect()} == {"text", "unclear"}
    assert {(r["type"], r["rule"]) for r in RuleSet().classify(rows).collect()} == {("unclear", "none")}
