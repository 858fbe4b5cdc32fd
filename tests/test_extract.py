import pytest
from pyspark.sql import functions as F

from blockyard.operators.extract import append_frames, clean_blocks, cut_page, extract_regions, find_elements, page_elements, page_regions, page_text
from blockyard.operators.page_tree import Page
from blockyard.operators.regions import drop_empty

PROSE = "Some prose that goes on, and on, for a while, so that it fills a line or two. " * 6
FILTER_PAGE = f"""<html><head><title>A title of the article | Site</title></head><body><header><nav><a href=/a>A</a><a href=/b>B</a><a href=/c>C</a><a href=/d>D</a><a href=/e>E</a></nav></header>
<div role=dialog class=cookie-note>We use cookies and need your consent.<button>Yes</button><button>No</button></div>
<article><h1>A title of the article</h1><p class=standfirst>What it is about, in a line.</p><p>{PROSE}</p><p>{PROSE}</p><div class=ad-unit>Buy now</div><p>{PROSE}</p><p>{PROSE}</p><div class=newsletter><h3>Newsletter</h3><form><input name=mail><button>Join</button></form></div></article>
<aside><h2>Related stories</h2><ul><li><a href=/1>One story</a><li><a href=/2>Two story</a><li><a href=/3>Three story</a></ul></aside>
<footer><a href=/p>Privacy</a> <a href=/t>Terms</a> <a href=/c>Contact</a> © 2024 Someone</footer></body></html>"""
PAGES = "page_id long, url string, html string"


def regions(source):
    return [(r["tag"], r["text"]) for r in page_regions(source)]


def test_implied_end_tags():
    page = Page("<head><title>t</title><ul><li>one<li>two</ul><p>a<p>b<table><tr><td>1<td>2<tr><td>3</table>")
    assert [page.tag[i] for i in page.children(0)] == ["head", "ul", "p", "p", "table"]
    ul, table = page.tag.index("ul"), page.tag.index("table")
    assert [page.tag[i] for i in page.children(ul)] == ["li", "li"]
    assert [len(page.children(r)) for r in page.children(table)] == [2, 1] and page.title == "t"


def test_text_and_counts_of_a_subtree():
    page = Page('<body><script>var t = "</p>";</script><p hidden>no</p><p>yes  &amp;\n so</p><br><a href=/x> a  link </a></body>')
    assert page.text(page.body()) == "no\nyes &\n so\n a link"
    assert page.count("links", 0) == 1 and page.link_text(0) == 7 and not page.seen[page.tag.index("p")]


def test_filter_page():
    found = page_regions(FILTER_PAGE)
    tags = [r["tag"] for r in found]
    assert tags.count("h1") == 1
    runs = [r for r in found if r["tag"].startswith("p")]
    assert runs[0]["text"].startswith("What it is about") and sum(r["text_length"] >= len(PROSE) - 2 for r in runs) >= 1
    assert all(r["landmarks"] == ["article"] and r["link_ratio"] == 0 for r in runs)
    assert any("Buy now" in r["text"] and "Some prose" in r["text"] for r in found)  # a tiny box joins what follows
    footer = found[-1]
    assert "footer" in [footer["tag"], *footer["landmarks"]] and footer["links"] == 3 and found[0]["page_title"] == "A title of the article | Site"


@pytest.mark.parametrize(
    "inner, tags",
    [
        ("<ul>" + "".join(f"<li>{PROSE}" for _ in range(4)) + "</ul>", ["ul"]),
        ("<form><label>Name</label><input><p>Why we ask</p><select><option>1</select></form>", ["form"]),
        (f"<p>{PROSE}</p><p>{PROSE}</p>", ["p×2"]),
        (f"<h2>{PROSE}</h2><h2>{PROSE}</h2><p>{PROSE}</p>", ["h2×2", "p"]),
        (f"<section>{PROSE}</section><div class=row><p>{PROSE * 2}</p></div>", ["section", "p"]),
    ],
)
def test_leaves_and_runs(inner, tags):
    assert [t for t, _ in regions(f"<body><div>{inner}</div></body>")] == tags


def test_landmarks_count_sections_and_regions():
    (row,) = page_regions(f"<body><section><div role=region><p>{PROSE}</p></div></section></body>")
    assert row["landmarks"] == ["section", "role=region"]


def test_header_zone_is_walked():
    source = f"<body><div><div><h1>Title here</h1><p>By someone of note</p></div><p>{PROSE}</p></div></body>"
    assert [t for t, _ in regions(source)] == ["h1", "p", "p"] or regions(source)[0][0] == "h1"


def test_layout_table_is_walked_data_table_is_a_leaf():
    layout = "<body><table><tr><td><p>%s</p></td><td><p>%s</p><p>%s</p></td></tr></table></body>" % ((PROSE * 3,) * 3)
    data = "<body><div><table><tr><th>a</th><th>b</th></tr><tr><td>%s</td><td>2</td></tr></table></div><p>%s</p></body>" % ((PROSE,) * 2)
    assert "table" not in [t for t, _ in regions(layout)]
    assert "table" in [t for t, _ in regions(data)]


def test_rows_become_a_run():
    source = "<body><div>" + "".join(f'<div class="card big"><h3>Card {i}</h3><p>{"text " * 60}</p></div>' for i in range(4)) + "</div></body>"
    assert [(r["tag"], r["repeats"]) for r in page_regions(source)] == [("div×4", 4)]
    assert len(page_regions(source, runs=False)) == 4


def test_deep_and_broken_pages():
    deep = page_regions("<body>" + "<div>" * 10_000 + PROSE + "</div>" * 10_000 + "</body>")
    assert len(deep) == 1 and deep[0]["text_length"] > 400
    nested = "<body>" + f"<div><p>{PROSE}</p>" * 40 + "</div>" * 40
    assert page_regions(nested)
    assert page_regions("<p><b>unclosed <i>x</p></div></b>") != [] and page_text


def test_empty_pages(spark):
    assert [r for r in page_regions("") if r["text_length"]] == [] and [r for r in page_regions(None) if r["text_length"]] == []
    df = spark.createDataFrame([(1, "http://a.b/", None), (2, "http://a.b/", "")], PAGES)
    assert [tuple(r) for r in page_text(df).orderBy("page_id").collect()] == [(1, "", 0, False, False), (2, "", 0, False, False)]
    assert drop_empty(extract_regions(df)).count() == 0 and page_elements(df).count() == 0 and find_elements(df, "x").count() == 0


def test_text_from_nested_shadow_and_decoy(spark):
    shadow = '<body><div><template shadowrootmode="open"><p>outer</p><div><template shadowrootmode=open><p>the marker</p></template></div></template></div></body>'
    decoy = "<body><article>short</article><div>%s</div></body>" % ("long body " * 40)
    df = spark.createDataFrame([(1, "u", shadow), (2, "u", decoy)], PAGES)
    a, b = page_text(df).orderBy("page_id").collect()
    assert "the marker" in a["text"] and a["via_shadow"]
    assert b["chars"] > 200 and not b["via_shadow"]


def test_boxes():
    source = '<body data-mx-r="0,0,1000,2000"><h1 data-mx-r="0,10,500,40">T</h1><div data-mx-r="0,60,1000,600"><a href=/x title="Go there" data-mx-r="0,60,1000,300"><p data-mx-r="500,60,500,300">%s</p></a><p data-mx-r="0,400,1000,300">%s</p><img width=4 height=4><img alt=big data-mx-r="0,500,300,200"></div></body>' % ((PROSE,) * 2)
    first, *rest = page_regions(source)
    assert first["geometry_source"] == "boxes" and first["top"] == 10 and first["width_fraction"] == 0.5 and first["above_fold"]
    linked = next(r for r in rest if r["cover_links"])
    assert linked["cover_label"] == "Go there" and linked["left_fraction"] in (0.0, 0.5)
    picture = next(r for r in rest if r["images"])
    assert picture["images"] == 1 and (picture["pictures"][0]["alt"], picture["pictures"][0]["width"]) == ("big", 300)


def test_append_frames_is_idempotent(spark):
    source = f'<body data-mx-r="0,0,1000,900"><p data-mx-r="0,0,900,200">{PROSE}</p><div data-mx-r="0,200,5,5"><iframe data-mx-r="0,300,79,400" src="https://a.b/"></iframe></div><iframe data-mx-h="1" data-mx-r="0,300,400,400"></iframe><iframe title="T" src="//www.video.example/x?y" data-mx-r="10,310,400,300"></iframe></body>'
    pages = spark.createDataFrame([(1, "https://s.t/p", source), (2, "https://s.t/q", "<p>no frame")], PAGES)
    regions = drop_empty(extract_regions(pages)).filter("frame_host is null").withColumn("idx", (F.col("idx")).cast("int"))
    once = append_frames(regions, pages)
    new = [r for r in once.collect() if r["frame_host"] is not None]
    assert [(r["page_id"], r["idx"], r["frame_host"], r["top"], r["frame_width"], r["frame_title"]) for r in new] == [(1, 1, "video.example", 310, 400, "T")]
    assert append_frames(once, pages).count() == once.count()


def test_elements_and_find(spark):
    source = """<body><nav><a href="/one">One</a><a href="/one">One</a><a>none</a></nav><h2 id=h>Head</h2><p>Some Text here</p>
<form><label for=m>Mail</label><input id=m type=checkbox checked><button aria-label="Send it" disabled>x</button><div role=button aria-labelledby=h aria-expanded=true></div><div hidden><button>no</button></div></form><div><section><b>deep text</b></section></div></body>"""
    df = spark.createDataFrame([(1, "https://a.b/x", source)], PAGES)
    rows = page_elements(df).orderBy("place").collect()
    assert [(r["role"], r["label"]) for r in rows] == [("link", "One"), ("heading", "Head"), ("checkbox", "Mail"), ("button", "Send it"), ("button", "Head")]
    assert rows[0]["href"] == "https://a.b/one" and rows[2]["checked"] and rows[3]["disabled"] and rows[4]["expanded"] == "true"
    assert ("p", "Some Text here") in [(r["role"], r["label"]) for r in page_elements(df, "all").collect()]
    assert page_elements(df, max_items=2).count() == 2
    assert [(r["role"], r["label"]) for r in find_elements(df, "TEXT").orderBy("place").collect()] == [("p", "Some Text here"), ("b", "deep text")]
    assert find_elements(df, "text", 1).count() == 1


def test_clean_blocks(spark):
    source = f'<body><div><p onclick="x()" class=c style="s">See <a href="/rel" data-x=1>it &amp; more</a><script>bad()</script><button>B</button><svg></svg>{PROSE}</p></div><div><img data-src="/lazy.png" src="data:image/gif;x" loading=lazy data-srcset="a 1x" width=300 height=200><iframe src="https://v.w/"></iframe><p>{PROSE}</p></div></body>'
    pages = spark.createDataFrame([(1, "https://a.b/c/", source)], PAGES)
    n = len(cut_page(source)[1])
    calls = spark.createDataFrame([(1, i, "prose" if i == 0 else "media", "text") for i in range(n)], "page_id long, idx int, block string, type string")
    rows = {r["idx"]: r["html"] for r in clean_blocks(pages, calls).collect()}
    assert rows[0].startswith('<p>See <a href="https://a.b/rel">it &amp; more</a>Some prose') and "button" not in rows[0] and "svg" not in rows[0]
    rest = "".join(rows[i] for i in range(1, n))
    assert '<img src="/lazy.png" width="300" height="200" srcset="a 1x">' in rest and '<iframe src="https://v.w/"></iframe>' in rest
