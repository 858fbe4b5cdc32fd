from blockyard.operators import requests as rq


def test_cosmetic_exceptions_and_allowlist(spark):
    lines = [(0, False, "##.ad"), (1, True, "a.example##.nag"), (2, False, "a.example#@#.ad"), (3, False, "~b.example##.promo"), (4, False, "b.example##.x"), (5, False, "a.example##+js(y)")]
    cosmetics = rq.parse_cosmetics(spark.createDataFrame(lines, "pos int, custom boolean, line string"))
    pages = spark.createDataFrame([(1, "https://www.a.example/p"), (2, "https://b.example/"), (3, "https://c.example/")], "page_id long, url string")
    got = lambda *a: {r["page_id"]: r["selectors"] for r in rq.cosmetic_selectors(pages, cosmetics, *a).collect()}
    assert got() == {1: [".nag", ".promo"], 2: [".ad", ".x"], 3: [".ad", ".promo"]}
    assert set(got(spark.createDataFrame([("a.example",)], "domain string"))) == {2, 3}


def test_equal_requests_are_decided_alike(spark):
    rows = [(i, "https://cdn.example/x.js", "https://a.example/" if i % 2 else None, None if i == 3 else "script") for i in range(6)]
    asked = spark.createDataFrame(rows, "request_id long, url string, page_url string, type string")
    match = spark.createDataFrame([(0, "one", True, "*a.example*")], "set_pos int, name string, enabled boolean, pattern string")
    none = spark.createDataFrame([], "set_pos int, pos int, from string, to string")
    block = spark.createDataFrame([(0, 0, "*x.js")], "set_pos int, pos int, pattern string")
    out = rq.decide_requests(asked, match, none, block).collect()
    assert len(out) == 6 and {(r["request_id"] % 2, r["decision"]) for r in out} == {(0, "allow"), (1, "block")}
