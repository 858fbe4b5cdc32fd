"""Region, label and call tables made from the given tables, for queries and tests.

A document stands for a page, its source for the site, and each line for a region; tags, landmarks, labels and calls
follow from the line by fixed rules, so that every operator has whole tables of any size to work on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Layers of (column, expression); the expressions are plain SQL that Spark and DuckDB read alike.
REGION_LAYERS = (
    {
        "tag": "case when idx = 0 and text_length < 90 then 'h1' when text_length < 30 then 'h2' when instr(text, '|') > 0 then 'ul' when instr(text, '@') > 0 then 'aside' else 'p' end",
        "class": "concat('flex-', lang, ' ', case when text_length > 200 then 'long-text' else 'short-text' end)",
        "landmark": "case when idx < 2 then 'header' when idx % 7 = 6 then 'aside' else 'main' end",
        "links": "length(text) - length(replace(text, '|', ''))",
    },
    {
        "link_ratio": "case when links >= 4 then 0.8 when links > 0 then 0.4 else 0.0 end",
        "paragraphs": "case when tag = 'p' then 1 else 0 end",
        "headings": "case when tag = 'h1' or tag = 'h2' then 1 else 0 end",
        "images": "0",
        "controls": "0",
        "repeats": "1",
    },
)
FINAL = (
    "case when tag = 'h1' then 'title' when tag = 'h2' then 'heading' when instr(text, 'rights reserved') > 0 or instr(text, 'Licensed') > 0 then 'legal_notice' "
    "when instr(text, '!!') > 0 then 'ad' when tag = 'ul' then 'related' when instr(text, '@') > 0 then 'comments' when instr(text, '$$') > 0 then 'sponsored' else 'text' end"
)
CALL = (
    "case when tag = 'h1' then 'title' when text_length < 40 then 'heading' when links >= 3 then 'teaser_card' when instr(text, 'rights') > 0 then 'legal_notice' "
    "when instr(text, '!!') > 0 and text_length < 300 then 'ad' when text_length >= 80 then 'text' else 'unclear' end"
)
RULE = (
    "case when tag = 'h1' then 'first-line' when text_length < 40 then 'short' when links >= 3 then 'linky' when instr(text, 'rights') > 0 then 'legal' "
    "when instr(text, '!!') > 0 and text_length < 300 then 'shouting' when text_length >= 80 then 'prose' else 'fallback' end"
)
KEYED = "concat(cast(page_id as {string}), ':', cast(idx as {string}), ':{salt}')"


def _fraction(salt: str, spark: bool) -> str:
    """A number from 0 to 1 that a row's key and the salt fix; the same in both engines."""
    key = KEYED.format(string="string" if spark else "varchar", salt=salt)
    head = f"substr(md5({key}), 1, 8)"
    return f"(cast(conv({head}, 16, 10) as double) / 4294967295D)" if spark else f"(('0x' || {head})::bigint::double / 4294967295::double)"


def _calls(u) -> tuple[dict[str, str], ...]:
    return (
        {"final": FINAL, "type": CALL, "rule": RULE, "u1": u("a"), "u2": u("b"), "u3": u("c")},
        {
            "tree_type": "case when u1 < 0.7 then final when u1 < 0.85 then type else 'text' end",
            "tree_conf": "round(u2, 3)",
            "review": "case when u3 < 0.1 then 'either' when u3 < 0.9 then 'ok' else 'unsure' end",
            "runner_up": "case when u1 < 0.5 then type else 'unclear' end",
        },
    )


def _layered(df: DataFrame, layers) -> DataFrame:
    for layer in layers:
        df = df.withColumns({name: F.expr(e) for name, e in layer.items()})
    return df


def _layered_sql(source: str, layers) -> str:
    for layer in layers:
        source = f"(select *, {', '.join(f'{e} as {name}' for name, e in layer.items())} from {source})"
    return source


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # The index counts the page's own lines, so it comes from the array and needs no window.
    told = docs.select(F.col("doc_id").alias("page_id"), F.col("source").alias("site"), "lang", F.posexplode(F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 0)).alias("idx", "line"))
    base = told.select("page_id", "site", "lang", "idx", F.left("line", F.lit(400)).alias("text"), F.length("line").alias("text_length"))
    return _layered(base, REGION_LAYERS).withColumn("landmarks", F.array("landmark"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions with a final label, a rule's call, a tree's call and a review."""
    return _layered(regions(spark, sf_dir), _calls(lambda s: _fraction(s, True)))


def regions_sql() -> str:
    lines = "(select doc_id as page_id, source as site, lang, list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0) as lines from documents)"
    each = f"(select page_id, site, lang, unnest(lines) as line, generate_subscripts(lines, 1) - 1 as idx from {lines})"
    return _layered_sql(f"(select page_id, site, lang, idx::int as idx, left(line, 400) as text, length(line)::int as text_length from {each})", REGION_LAYERS)


def labelled_sql() -> str:
    return _layered_sql(regions_sql(), _calls(lambda s: _fraction(s, False)))


TYPES_BY_RUN = ("text", "heading", "related", "ad", "comments", "teaser_card")


def label_run(spark: SparkSession, sf_dir: str, run: str) -> DataFrame:
    """Regions with probabilities, as a model's run would give them: (page_id, idx, url, text, seq, probabilities, input_tokens)."""
    raw = regions(spark, sf_dir).withColumns({f"w{i}": F.expr(_fraction(f"{run}{i}", True)) for i in range(len(TYPES_BY_RUN))})
    total = sum((F.pow(F.col(f"w{i}"), F.lit(4)) for i in range(1, len(TYPES_BY_RUN))), F.pow(F.col("w0"), F.lit(4)))
    pairs = [x for i, t in enumerate(TYPES_BY_RUN) for x in (F.lit(t), F.pow(F.col(f"w{i}"), F.lit(4)) / total)]
    return raw.select("page_id", "site", "idx", "tag", "text_length", F.concat(F.lit("doc:"), F.col("page_id").cast("string")).alias("url"), "text", F.col("idx").alias("seq"), F.create_map(*pairs).alias("probabilities"), (F.col("text_length") + 100).alias("input_tokens"))


def label_run_sql(run: str) -> str:
    """The same run, ranked: choice, confidence, margin and the runner-up."""
    w = ", ".join(f"{_fraction(f'{run}{i}', False)} as w{i}" for i in range(len(TYPES_BY_RUN)))
    total = " + ".join(f"pow(w{i}, 4)" for i in [0, *range(1, len(TYPES_BY_RUN))])
    rows = ", ".join(f"{{'p': pow(w{i}, 4) / ({total}), 'type': '{t}'}}" for i, t in enumerate(TYPES_BY_RUN))
    ranked = f"(select *, list_sort(list_transform([{rows}], lambda x: {{'by': -x.p, 'type': x.type}})) as r from (select *, {w} from {regions_sql()}))"
    return f"(select page_id, site, idx, tag, text, text_length, concat('doc:', page_id) as url, idx as seq, text_length + 100 as input_tokens, r, r[1].type as choice, round(-r[1].by, 3) as confidence, round(r[2].by - r[1].by, 3) as margin, r[2].type as second from {ranked})"


REQUEST_TYPES = ("script", "image", "document", "xhr")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as page requests: (request_id, tab_id, ts, url, page_url, type, navigation, title, blocked)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_id").alias("request_id"), F.col("user_id").alias("tab_id"), "ts", *(F.expr(x).alias(n) for n, x in REQUEST.items()))


REQUEST = {
    "url": "concat('https://', case when event_id % 5 = 0 then 'ads.tracker.example' when event_id % 5 = 1 then 'cdn.example.org' else concat('www.site', cast(user_id % 20 as {s}), '.example.com') end, '/', event_type, '/', cast(event_id % 97 as {s}), case when event_id % 3 = 0 then '/banner/x.js' else '/page.html' end)",
    "page_url": "concat('https://www.site', cast(user_id % 20 as {s}), '.example.com/', case when event_id % 11 = 0 then 'shop' else 'news' end, '/page/', cast(event_id % 4 as {s}))",
    "type": "case when event_type = 'view' then 'document' when event_id % 3 = 0 then 'script' when event_id % 3 = 1 then 'image' else 'xhr' end",
    "navigation": "event_type = 'view'",
    "title": "concat('T', cast(event_id % 6 as {s}))",
    "blocked": "event_id % 5 = 0",
}
REQUESTS_SQL = "(select event_id as request_id, user_id as tab_id, ts, " + ", ".join(f"{x.format(s='varchar')} as {n}" for n, x in REQUEST.items()) + " from events)"
REQUEST = {n: x.format(s="string") for n, x in REQUEST.items()}
