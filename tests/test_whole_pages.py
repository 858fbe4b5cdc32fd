"""Long texts, many pictures, names and regions: all of them count."""

from pyspark.sql import functions as F

from blockyard.functions.lexicon import flag_sql
from blockyard.operators.extract import clean_blocks
from blockyard.plans.flagship import classify_pages, region_features

PAGES = "page_id long, url string, html string"
LINE = "Some prose, that goes on for a while. "


def test_text_statistics_count_whole_texts(spark):
    """200 sentences of 8 words each, and what is said last."""
    said = "<br>".join([LINE] * 200) + "<br>The END. We may earn a commission"
    found = region_features(spark.createDataFrame([(1, "https://s.example/x", f"<body><p>{said}</p></body>")], PAGES))
    row = found.withColumn("disclosure", F.expr(flag_sql("x", "disclosure"))).first()
    assert len(row["text"]) == row["text_length"] > 7000 and row["text"].endswith("a commission")
    assert (row["words"], row["commas"], row["sentences"], row["lines"], row["caps_words"]) == (200 * 8 + 7, 200, 201, 201, 1) and row["disclosure"]


def test_flags_look_at_all_pictures(spark):
    """Five flat pictures are larger than the sixth, which alone is big; icons come last."""
    flat = "".join(f'<img src=/{i} width=1000 height=70>' for i in range(5))
    pages = [(1, "https://s.example/x", f"<body><figure>{flat}<img src=/big width=130 height=90></figure></body>"), (2, "https://s.example/y", "<body><figure>" + "<img src=/i width=60 height=60>" * 4 + "<img src=/w width=70 height=10></figure></body>")]
    one, two = region_features(spark.createDataFrame(pages, PAGES)).orderBy("page_id").collect()
    assert len(one["pictures"]) == one["images"] == one["wide_images"] == 6 and one["big_image"] and one["image_area"] == 70_000
    assert len(two["pictures"]) == 5 and not two["icons_only"]


def test_every_block_of_a_long_page_is_cleaned(spark):
    inner = "".join(f"<h2>Head {i} of it</h2><p>{LINE * 2}{i}</p>" for i in range(900))
    pages = spark.createDataFrame([(1, "https://s.example/x", f"<body><main>{inner}</main></body>")], PAGES)
    calls = classify_pages(pages).select("page_id", "idx", "block", F.col("stack_type").alias("type"))
    blocks = [r["html"] for r in clean_blocks(pages, calls).orderBy("idx").collect()]
    assert len(blocks) == 1800 and "".join(blocks) == inner


def test_rules_see_whole_names(spark):
    """A fifth class, and what stands after the 80th character of a label, an id and a frame's title."""
    far, prose = "x" * 90, f"<section><p>{LINE * 12}</p></section>"
    parts = [
        f"<div class='a1 b2 c3 d4 breadcrumb'>{LINE * 3}<a href=/a>Home</a></div>", f"<div aria-label='{far} breadcrumb'>{LINE * 3}<a href=/a>Home</a></div>",
        f"<div id='{far}-breadcrumb'>{LINE * 3}<a href=/a>Home</a></div>", f"<iframe title='{far} intercom' src='https://w.example/' width=640 height=360></iframe>",
    ]
    pages = spark.createDataFrame([(i, f"https://s{i}.example/x", f"<body><main>{prose}{p}{prose}</main></body>") for i, p in enumerate(parts)], PAGES)
    rules = classify_pages(pages).filter("class is not null or aria_label is not null or id is not null or frame_host is not null").select("page_id", "rule")
    assert sorted(map(tuple, rules.collect())) == [(0, "breadcrumbs"), (1, "breadcrumbs"), (2, "breadcrumbs"), (3, "frame-chat")]


def test_vectors_count_every_word(spark):
    """300 words of one kind and 100 of another after them."""
    from blockyard.operators.vectors import NAMES, token_hash, vectorize

    pages = spark.createDataFrame([(1, "https://s.example/x", f"<body><p>{'many ' * 300}{'others ' * 100}</p></body>")], PAGES)
    v = dict(zip(NAMES, vectorize(classify_pages(pages)).first()["features"]))
    assert (v[f"w:{token_hash('many') % 256}"], v[f"w:{token_hash('others') % 256}"], v["n:words"]) == (0.75, 0.25, 400)
