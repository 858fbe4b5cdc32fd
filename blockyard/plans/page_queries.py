"""Further registered queries: page elements, frames, covers, flags, vectors, files and gates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.geometry import overlap
from ..functions.lexicon import HINTS, TEXTS, flag_columns, lowered, set_flags
from ..operators import cover
from ..operators import labels as la
from ..operators import links as li
from ..operators import regions as re_
from ..operators import scoring as sc
from ..operators.extract import append_frames, clean_blocks, extract_regions, find_elements, page_elements
from ..operators.vectors import vectorize
from ..sources import files
from ..sources.shared import shared_folder
from .derived import label_run_sql, labelled, labelled_sql, regions, regions_sql
from .flagship import classify_pages

RECTANGLES = (
    "(select l_orderkey as page_id, cast(l_linenumber as int) as idx, cast(l_partkey % 300 as double) as \"left\", cast((l_suppkey * 37) % 1500 as double) as top, cast(40 + l_quantity * 9 as double) as width, "
    "cast(20 + (l_partkey * 7) % 600 as double) as height, cast(1 + l_linenumber % 3 as int) as repeats, case when l_partkey % 3 = 0 then concat('label ', cast(l_suppkey as varchar)) end as label from lineitem)"
)
# An order may have several lines of one number: the smallest of each measure stands for them.
RECTANGLES = f"(select page_id, idx, {', '.join(f'min({c}) as {c}' for c in ('\"left\"', 'top', 'width', 'height', 'repeats', 'label'))} from {RECTANGLES} group by page_id, idx)"
AREA = "greatest(least(r.\"left\" + r.width, a.\"left\" + a.width) - greatest(r.\"left\", a.\"left\"), 0) * greatest(least(r.top + r.height, a.top + a.height) - greatest(r.top, a.top), 0)"
SITE = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '')"
HASH01 = f"(('0x' || substr(md5({SITE}), 1, 8))::bigint::double / 4294967295::double)"
#: Patterns that look ahead, which DuckDB's cannot: what must not follow is taken out first, the rest of the pattern is as it was.
AHEAD = {"h:byline": ("author(?!-bio)", "author-bio", "author"), "h:card": (r"\bcard(?!__heading)", "card__heading", r"\bcard")}


def rectangles(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    each = e.select(
        F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").cast("int").alias("idx"), (F.col("l_partkey") % 300).cast("double").alias("left"), ((F.col("l_suppkey") * 37) % 1500).cast("double").alias("top"), (40 + F.col("l_quantity") * 9).cast("double").alias("width"),
        (20 + (F.col("l_partkey") * 7) % 600).cast("double").alias("height"), (1 + F.col("l_linenumber") % 3).cast("int").alias("repeats"), F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("label "), F.col("l_suppkey").cast("string"))).alias("label"),
    )
    return each.groupBy("page_id", "idx").agg(*(F.min(c).alias(c) for c in ("left", "top", "width", "height", "repeats", "label")))


def pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def own_folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def flag_count_sql(source: str | None = None) -> str:
    quote = lambda p: "'" + lowered(p).replace("'", "''") + "'"

    def hinted(k: str, p: str) -> str:
        if f"h:{k}" not in AHEAD:
            return f"regexp_matches(hint, {quote(p)})"
        part, without, alone = AHEAD[f"h:{k}"]
        others = "|".join(x for x in p.split("|") if x != part)
        return f"(regexp_matches(hint, {quote(others)}) or regexp_matches(regexp_replace(hint, '{without}', '#', 'g'), {quote(alone)}))"

    rows = [(f"h:{k}", hinted(k, p)) for k, p in HINTS.items()] + [(f"x:{k}", f"regexp_matches(low, {quote(p)})") for k, p in TEXTS.items()]
    tests = ", ".join(f"case when {c} then '{n}' end" for n, c in rows)
    return f"""select flag, count(*) as matches from (select unnest([{tests}]) as flag from (select lower(class) as hint, lower(trim(text)) as low from {source or regions_sql()})) where flag is not null group by flag"""


def flag_counts(told):
    """(flag, matches) of rows (hint, low, n), n of a kind; rows that have the same flags are added up before the flags are named."""
    flags = told.withColumns(flag_columns(F.col("hint"), F.col("low"))).groupBy("hints_0", "hints_1", "texts_0").agg(F.sum("n").alias("n"))
    return flags.select(F.explode(set_flags()).alias("flag"), "n").groupBy("flag").agg(F.sum("n").alias("matches"))


def register(query) -> None:
    @query(f"""with r as (select * from {RECTANGLES} where idx % 2 = 1), a as (select * from {RECTANGLES} where idx % 2 = 0 and width >= 20 and height >= 10),
    m as (select r.page_id, r.idx, a.idx as pos, left(a.label, 120) as label from r join a on r.page_id = a.page_id where {AREA} >= 0.5 * (r.width * r.height) or ({AREA} >= 0.9 * (a.width * a.height) and a.width * a.height >= 0.4 * (r.width * r.height) / r.repeats)),
    c as (select page_id, idx, count(*) as n, arg_min(label, pos) filter (label is not null) as label from m group by 1, 2)
    select r.page_id, r.idx, coalesce(n, 0)::int as cover_links, c.label as cover_label from (select distinct page_id, idx from r) r left join c using (page_id, idx)""")
    def j2_cover_links(spark, sf_dir):
        boxes = rectangles(spark, sf_dir)
        parts = boxes.filter("idx % 2 = 1").drop("label")
        return cover.with_cover_links(parts, boxes.filter("idx % 2 = 0").withColumnRenamed("idx", "pos").drop("repeats")).select("page_id", "idx", "cover_links", "cover_label")

    @query(f"select r.page_id, r.idx, {AREA} as area from {RECTANGLES} r join {RECTANGLES} a on r.page_id = a.page_id and a.idx = r.idx + 1")
    def f14_overlap(spark, sf_dir):
        boxes = rectangles(spark, sf_dir)
        box = lambda df: F.struct("left", "top", "width", "height")
        a, b = boxes.select("page_id", "idx", box(boxes).alias("r")), boxes.select("page_id", (F.col("idx") - 1).alias("idx"), box(boxes).alias("a"))
        sides = lambda p: tuple(F.col(f"{p}.{c}") for c in ("left", "top", "width", "height"))
        return a.join(b, ["page_id", "idx"]).select("page_id", "idx", overlap(sides("r"), sides("a")).alias("area"))

    @query(f"""select page_id, (row_number() over (partition by page_id order by idx) - 1)::int as idx, text from {regions_sql()} where idx % 3 <> 1 or text_length > 100""")
    def p4_drop_empty(spark, sf_dir):
        some = regions(spark, sf_dir)
        return re_.drop_empty(some.withColumn("text_length", F.expr("case when idx % 3 = 1 and text_length <= 100 then 0 else text_length end"))).select("page_id", "idx", "text")

    @query(f"""with c as (select page_id, count(*) as regions, count(*) filter (final not in ('ad', 'sponsored', 'legal_notice', 'related')) as kept from {labelled_sql()} group by page_id)
    select page_id, regions, kept, case when regions < 3 then 'few regions' when kept < 2 then 'few kept' end as reason, case when regions < 3 or kept < 2 then 'contained' else 'relayout' end as tier from c""")
    def p12_gate_pages(spark, sf_dir):
        kept = F.sum((~F.col("final").isin("ad", "sponsored", "legal_notice", "related")).cast("long"))
        return li.gate_pages(labelled(spark, sf_dir).groupBy("page_id").agg(F.count("*").alias("regions"), kept.alias("kept")))

    @query(f"""select page_id, idx + (page_id % 2) * 1000 as idx, verdict from (select page_id, idx, case when page_id % 4 = 0 then 'ok' else 'unsure' end as verdict from {regions_sql()} where page_id % 3 = 0) where (page_id % 2) * 1000 + idx > 999""")
    def u4_unknown_judgements(spark, sf_dir):
        told = regions(spark, sf_dir).filter("page_id % 3 = 0").select("page_id", (F.col("idx") + F.col("page_id") % 2 * 1000).alias("idx"), F.expr("case when page_id % 4 = 0 then 'ok' else 'unsure' end").alias("verdict"))
        return la.unknown_judgements(told, regions(spark, sf_dir))

    @query(flag_count_sql())
    def f9_flag_counts(spark, sf_dir):
        return flag_counts(regions(spark, sf_dir).select(F.lower("class").alias("hint"), F.lower(F.trim("text")).alias("low"), F.lit(1).alias("n")))

    named = ["author author-bio", "author-bio", "p-author-bio", "card card__heading", "card__heading", "my-card", "postcard", "byline", "x-timestamp"]
    names = "[" + ", ".join(f"'{n}'" for n in named) + "]"

    @query(flag_count_sql(f"(select {names}[(l_orderkey % {len(named)} + 1)::bigint] as class, '' as text from lineitem)"))
    def f9_name_flags(spark, sf_dir):
        """Names that a pattern takes or leaves by what follows."""
        told = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.element_at(F.array(*map(F.lit, named)), (F.col("l_orderkey") % len(named) + 1).cast("int")).alias("hint"))
        return flag_counts(told.groupBy("hint").agg(F.count("*").alias("n")).withColumn("low", F.lit("")))

    @query(f"select page_id::varchar as id, {SITE} as site, case when length(html) > 1500 then 'relayout' else 'contained' end as tier, length(html)::int as regions, length(html) % 2 = 0 as domTruncated from pages")
    def s2_read_captures(spark, sf_dir):
        """Captures of all pages, written as lists of some hundred a file, as a crawler's days are packed."""
        path = own_folder(spark, "captures")
        told = files.read_pages(spark, f"{sf_dir}/pages.parquet").withColumn("n", F.length("html"))
        rows = told.select(F.col("page_id").cast("string").alias("id"), "site", F.expr("case when n > 1500 then 'relayout' else 'contained' end").alias("tier"), F.col("n").cast("int").alias("regions"), (F.col("n") % 2 == 0).alias("domTruncated"))
        files.write_captures(rows, path)
        return files.read_captures(spark, path, "part-*").select("id", "site", "tier", "regions", "domTruncated")

    @query(f"select page_id::varchar as page_id, idx, case when idx % 3 = 0 then 'ok' when idx % 3 = 1 then 'wrong:heading' else 'unsure' end as verdict from {regions_sql()}")
    def s6_read_judgements(spark, sf_dir):
        """Verdicts of all regions, a map a file for some pages each."""
        path = own_folder(spark, "judgements")
        told = regions(spark, sf_dir).select("page_id", F.concat_ws(":", F.col("page_id").cast("string"), F.col("idx").cast("string")).alias("id"), F.expr("case when idx % 3 = 0 then 'ok' when idx % 3 = 1 then 'wrong:heading' else 'unsure' end").alias("verdict"))
        maps = told.groupBy(F.floor(F.col("page_id") / 50).alias("some")).agg(F.map_from_entries(F.collect_list(F.struct("id", "verdict"))).alias("m"))
        maps.select(F.to_json("m").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
        return files.read_judgements(spark, path)

    @query(f"""with r as (select *, confidence < 0.5 as low, row_number() over (order by confidence) - 1 as k, count(*) over () as total from {label_run_sql("one")})
    select count(*) as n, count(*) filter (low) as flagged, min(confidence) as min, max(confidence) as max, min(confidence) filter (k >= floor(total * 0.25)) as p25, min(confidence) filter (k >= floor(total * 0.5)) as median, min(confidence) filter (k >= floor(total * 0.75)) as p75,
    sum(input_tokens)::bigint as tokens, round(sum(input_tokens) * 0.042 / 1e6, 6) as cost from r""")
    def a14_run_stats(spark, sf_dir):
        from .queries import ranked_run

        return la.run_stats(ranked_run(spark, sf_dir))

    @query(f"select page_id, {SITE} as site, case when {HASH01} < 0.25 then 'holdout' else 'dev' end as split from pages")
    def s1_read_pages(spark, sf_dir):
        return files.read_pages(spark, f"{sf_dir}/pages.parquet").select("page_id", "site", "split")

    @query("select '||' || regexp_extract(url, '://([^/]*)', 1) || '^' as line, false as custom from pages")
    def s4_read_filters(spark, sf_dir):
        path = own_folder(spark, "filters")
        pages(spark, sf_dir).select(F.explode(F.array(F.concat(F.lit(" ||"), F.regexp_extract("url", "://([^/]*)", 1), F.lit("^ ")), F.lit(" "))).alias("value")).write.text(path)
        return files.read_filters(spark, path).select("line", "custom")

    @query(f"select {SITE} as site, array_to_string(list_sort(list(distinct regexp_replace(url, '#.*$', ''))), ' ') as urls from pages group by 1")
    def s5_read_site_list(spark, sf_dir):
        path = own_folder(spark, "sites")
        pages(spark, sf_dir).select(F.explode(F.array(F.concat("url", F.lit("  # page "), F.col("page_id").cast("string")), F.lit("# only a note"))).alias("value")).write.text(path)
        return files.read_site_list(spark, path).select("site", F.array_join("urls", " ").alias("urls"))

    @query(f"select case when run = 1 then 'one' else 'two' end as run_id, final as type, count(*) as n from {labelled_sql()}, (select unnest([1, 2]) as run) group by 1, 2")
    def s8_scorecard_history(spark, sf_dir):
        path = own_folder(spark, "card")
        card = labelled(spark, sf_dir).groupBy(F.col("final").alias("type")).agg(F.count("*").alias("n"))
        files.write_scorecard(card, path, "one")
        before = files.write_scorecard(card, path, "two")
        if before is None or files.write_scorecard(card, path, "three", filtered=True) is not None:
            raise RuntimeError("a run did not see the one before, or a filtered run was written")
        return files.scorecard_history(spark, path).select("run_id", "type", "n")

    @query(f"select page_id, idx, tree_type, round(tree_conf, 3) as tree_conf from {labelled_sql()}")
    def s10_out_of_fold_calls(spark, sf_dir):
        path = own_folder(spark, "oof")
        files.write_oof(labelled(spark, sf_dir), path)
        return files.read_oof(spark, path)

    @query()
    def p5_append_frames(spark, sf_dir):
        return append_frames(re_.drop_empty(extract_regions(pages(spark, sf_dir))), pages(spark, sf_dir)).select("page_id", "idx", "tag", "frame_host")

    @query()
    def p7_page_elements(spark, sf_dir):
        return page_elements(pages(spark, sf_dir), "all")

    @query()
    def p8_find_elements(spark, sf_dir):
        return find_elements(pages(spark, sf_dir), "the")

    @query()
    def p9_clean_blocks(spark, sf_dir):
        calls = classify_pages(pages(spark, sf_dir))
        return clean_blocks(pages(spark, sf_dir), calls.select("page_id", "idx", "block", F.col("stack_type").alias("type")))

    @query()
    def x3_vectors(spark, sf_dir):
        return vectorize(classify_pages(pages(spark, sf_dir))).select("page_id", "idx", "features")

    @query(f"select threshold, type, n, \"right\" from (select threshold, final as type, count(*) as n, count(*) filter (case when tree_conf >= threshold then tree_type else type end = final) as \"right\" from {labelled_sql()}, (select unnest([0.0, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::double as threshold) group by 1, 2) where n >= 5")
    def a12_blend_by_type(spark, sf_dir):
        return sc.blend_sweep_by_type(labelled(spark, sf_dir))
