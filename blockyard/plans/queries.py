"""Registered queries: each applies an operator to whole tables; SQL says the same for DuckDB where it can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sites, text, urls
from ..functions.taxonomy import types_sql, types_table
from ..operators import directory as di
from ..operators import labels as la
from ..operators import links as li
from ..operators import regions as re_
from ..operators import requests as rq
from ..operators import scoring as sc
from ..operators import trees
from ..operators.extract import extract_regions, page_text
from ..operators.policies import apply_policies
from ..sources import files
from .flagship import classify_pages, count_blocks, learned_stack, page_blocks
from .derived import REQUESTS_SQL, label_run, label_run_sql, labelled, labelled_sql, regions, regions_sql, requests

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


HOST = r"regexp_replace(lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^[^@]*@', '')), '^www\.', '')"
PATH = r"(case when regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) = '' then '/' else regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) end)"
ORIGIN = r"regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
HASH01 = "(('0x' || substr(md5(site), 1, 8))::bigint::double / 4294967295::double)"
SELECTOR = "landmark || ' > ' || tag || case when text_length > 200 then '.long-text' else '.short-text' end"

# ---------------------------------------------------------------- functions


@query(f"select page_id, {HOST} as host, {PATH} as path, {ORIGIN} || {PATH} as key, len(list_filter(string_split({PATH}, '/'), lambda x: x <> ''))::int as depth, regexp_replace({HOST}, '^[^.]*\\.', '') as parent, regexp_replace(regexp_replace({HOST}, '[^a-zA-Z0-9]+', '-', 'g'), '^-|-$', '') as slug, not regexp_matches({PATH}, '(?i)\\.pdf$') and regexp_matches(url, '(?i)^https?://') as eligible from pages")
def f1_url_parts(spark, sf_dir):
    u = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", urls.host(u).alias("host"), urls.path(u).alias("path"), urls.url_key(u).alias("key"), urls.path_depth(u).alias("depth"), urls.parent_host(urls.host(u)).alias("parent"), urls.slug(urls.host(u)).alias("slug"), urls.is_page_url(u).alias("eligible"))


@query(f"select site, case when {HASH01} < 0.25 then 'holdout' else 'dev' end as split, (floor({HASH01} * 4)::int % 4)::int as fold, count(*) as pages from (select source as site from documents) group by site")
def f6_site_folds(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").groupBy(F.col("source").alias("site")).agg(F.count("*").alias("pages"))
    return docs.select("site", sites.split_of(F.col("site")).alias("split"), sites.fold_of(F.col("site"), 4).alias("fold"), "pages")


@query("""select bucket, count(*) as words from (select list_reduce(list_prepend(2166136261::bigint, list_transform(string_split(w, ''), lambda c: unicode(c)::bigint)), lambda h, c: ((xor(h, c) * 16777619) & 4294967295))::bigint % 256 as bucket
from (select unnest(regexp_extract_all(text, '[^ \\n]+')) as w from documents)) group by bucket""")
def f7_token_buckets(spark, sf_dir):
    words = read(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^ \n]+"), F.lit(0))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return words.groupBy((text.fnv1a(F.col("w")) % 256).alias("bucket")).agg(F.sum("n").alias("words"))


@query(f"""select page_id, idx, len(regexp_extract_all(trim(text), '[^ \\t\\n\\r\\x0b\\x0c]+'))::int as words, len(regexp_extract_all(trim(text), '[,،，]'))::int as commas, len(regexp_extract_all(trim(text), '[.!?]([ \\t\\n\\r]|$)'))::int as sentences,
len(regexp_extract_all(trim(text), '\\b[A-Z]{{3,}}\\b'))::int as caps_words, text_length < 40 as short, text_length >= 80 and link_ratio < 0.3 and (len(regexp_extract_all(trim(text), '[.!?]([ \\t\\n\\r]|$)')) > 0 or len(regexp_extract_all(trim(text), '[,،，]')) > 0 or len(regexp_extract_all(trim(text), '[^ \\t\\n\\r\\x0b\\x0c]+')) > 15) as prose from {regions_sql()}""")
def f8_text_features(spark, sf_dir):
    return re_.with_text_features(regions(spark, sf_dir)).select("page_id", "idx", "words", "commas", "sentences", "caps_words", "short", "prose")


LINES = r"""list_filter(string_split(trim(coalesce(text, '')), chr(10)), lambda x: trim(x) <> '')"""


@query(f"""select page_id, idx, len({LINES})::int as lines, case when len({LINES}) > 0 then length(trim(text))::double / len({LINES}) else 0.0 end as avg_line, ln(1 + length(trim(coalesce(text, '')))::double) as log_length from {regions_sql()}""")
def f8_line_features(spark, sf_dir):
    return re_.with_text_features(regions(spark, sf_dir)).select("page_id", "idx", "lines", "avg_line", "log_length")


@query(f"select site, count(*) as n, list_sort(list(text_length))[(least(count(*) - 1, floor(count(*) * 0.25)) + 1)::bigint] as p25, list_sort(list(text_length))[(least(count(*) - 1, floor(count(*) * 0.5)) + 1)::bigint] as median from {regions_sql()} group by site")
def f10_rank_quantiles(spark, sf_dir):
    """Exact ranks per site without gathering a site: counts of equal lengths are summed up in order."""
    counts = regions(spark, sf_dir).groupBy("site", "text_length").agg(F.count("*").alias("c"))
    upto = counts.withColumn("upto", F.sum("c").over(Window.partitionBy("site").orderBy("text_length"))).withColumn("n", F.sum("c").over(Window.partitionBy("site")))
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.col("n") * p)), F.col("text_length")))
    return upto.groupBy("site").agg(F.sum("c").alias("n"), at(0.25).alias("p25"), at(0.5).alias("median"))


# ---------------------------------------------------------------- pages and links

LINKS = rf"""raw as (select page_id, url as page_url, regexp_extract_all(html, '(?is)<a\s[^>]*?href="([^"]*)"', 1) as hs from pages),
each as (select page_id, page_url, unnest(hs) as h, generate_subscripts(hs, 1) - 1 as pos from raw),
a as (select page_id, page_url, pos, case when regexp_matches(h, '(?i)^[a-z][a-z0-9+.-]*://') then h when h like '//%' then regexp_extract(page_url, '^([a-z]+:)', 1) || h when h like '/%' then {ORIGIN.replace('url', 'page_url')} || h else regexp_replace({ORIGIN.replace('url', 'page_url')} || {PATH.replace('url', 'page_url')}, '[^/]*$', '') || h end as url from each where h <> '' and not regexp_matches(h, '(?i)^(#|javascript:|mailto:)')),
k as (select *, {ORIGIN} || {PATH} as key, len(list_filter(string_split({PATH}, '/'), lambda x: x <> ''))::int as depth from a),
g as (select * from k where {HOST} = {HOST.replace('url', 'page_url')} and not regexp_matches({PATH}, '(?i)\.(pdf|zip|jpg|png|gif|mp4|mp3|xml|rss)$') and not regexp_matches({PATH}, '(?i)/(login|signin|signup|register|account|cart|checkout|search|tag|tags|author|feed|rss|privacy|terms|cookies?|contact|about)(?:[^A-Za-z0-9_]|$)') and key <> {ORIGIN.replace('url', 'page_url')} || {PATH.replace('url', 'page_url')}),
o as (select page_id, key, arg_min(url, pos) as href, arg_min(depth, pos) as depth, min(pos) as pos from g group by page_id, key),
links as (select page_id, key, regexp_replace(href, '#.*$', '') as href, depth, place from (select *, (row_number() over (partition by page_id order by depth desc, pos))::int as place from o) where place <= 40)"""


@query(f"with {LINKS} select * from links")
def p10_page_links(spark, sf_dir):
    return li.page_links(read(spark, sf_dir, "pages"))


DISCOVER = rf"""{LINKS}, ps as (select href, page_id, place, depth, {HOST.replace('url', 'href')} as site from links),
d as (select site, href, max(depth) as depth, min({{'page_id': page_id, 'place': place}}) as seen from ps group by site, href),
fresh as (select * from d where href not in (select url from pages)),
t as (select *, (depth >= 2)::int as dd, row_number() over (partition by site, depth >= 2 order by depth desc, seen) as t from fresh),
m as (select site, href, (row_number() over (partition by site order by t, dd desc))::int as turn from t),
have as (select {HOST} as site, count(*) as n from pages group by 1),
found as (select m.site, m.href, m.turn from m left join have using (site) where turn <= 12 - coalesce(n, 0))"""


@query(f"with {DISCOVER} select * from found")
def w7_discover_pages(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    return li.discover_pages(li.page_links(pages), pages.select("url"), per_site=12)


@query(rf"""with {DISCOVER}, taken as (select regexp_replace(regexp_replace({HOST}, '[^a-zA-Z0-9]+', '-', 'g'), '^-|-$', '') || '-' || (page_id % 3 + 1)::varchar as id from pages group by 1),
n as (select *, regexp_replace(regexp_replace(site, '[^a-zA-Z0-9]+', '-', 'g'), '^-|-$', '') as base, row_number() over (partition by site order by turn) as k from found),
f as (select base, b.n, row_number() over (partition by base order by b.n) as k from (select distinct base from n) cross join range(1, 40) b(n) where base || '-' || b.n::varchar not in (select id from taken))
select site, href, turn, n.base || '-' || f.n::varchar as id from n join f on n.base = f.base and n.k = f.k""")
def w8_allocate_ids(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    new = li.discover_pages(li.page_links(pages), pages.select("url"), per_site=12)
    taken = pages.select(F.concat_ws("-", urls.slug(urls.host(F.col("url"))), (F.col("page_id") % 3 + 1).cast("string")).alias("id")).distinct()
    return li.allocate_ids(new, taken)


@query(rf"""with {DISCOVER}, old as (select {HOST} as site, url from pages where page_id % 2 = 0), new as (select {HOST} as site, url from pages)
select site, url from old union all select site, url from new where (site, url) not in (select (site, url) from old)""")
def u1_append_pages(spark, sf_dir):
    listed = read(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("site"), "url")
    return li.append_pages(listed.filter("page_id % 2 = 0").select("site", "url"), listed.select("site", "url"))


@query(rf"""with {LINKS}, w as (select page_id as id, page_id + (page_id % 7 = 0)::int * 1000000 as source_id, '/' || substr('thea', 1 + (page_id % 3)::int, 2) as pattern from pages),
h as (select w.*, a.url as href, a.pos from w left join a on a.page_id = w.source_id)
select id, source_id, pattern, arg_min(href, pos) filter (contains(href, pattern)) as href, case when count(href) = 0 then 'source page missing' when count(*) filter (contains(href, pattern)) = 0 then 'no link matches' end as error from h group by id, source_id, pattern""")
def j10_resolve_via(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    wanted = pages.select(F.col("page_id").alias("id"), (F.col("page_id") + F.when(F.col("page_id") % 7 == 0, 1000000).otherwise(0)).alias("source_id"), F.expr("concat('/', substr('thea', 1 + cast(page_id % 3 as int), 2))").alias("pattern"))
    return li.resolve_via(wanted, li.anchors(pages))


@query("select doc_id, least(100, length(text)) as chars, case when length(text) < 60 and coalesce(split_part(text, chr(10), 1), '') = '' then 'skipped' when length(text) < 200 or n_chars % 50 < 5 or n_chars % 3000 < 200 then 'failed' else 'ok' end as status from documents")
def p11_crawl_health(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    pages = docs.select("doc_id", F.substring_index("text", "\n", 1).alias("title"), "text", (F.col("n_chars") % 50).alias("elements"), (F.col("n_chars") % 3000).alias("height"), F.lit(500).alias("extracted"), F.lit(9).alias("items"))
    return li.crawl_health(pages).select("doc_id", F.least(F.lit(100), F.length("text")).alias("chars"), "status")


# ---------------------------------------------------------------- regions

SIG = "tag || '|' || split_part(class, ' ', 1) || '|' || left(regexp_replace(lower(text), '[ \\t\\n\\r\\x0b\\x0c]+', ' ', 'g'), 60)"
INDEX = f"r as (select *, {SIG} as signature from {regions_sql()}), ix as (select site, signature, count(distinct page_id) as repeat_pages from r where text_length >= 6 group by site, signature)"


@query(f"with {INDEX} select * from ix")
def a1_site_index(spark, sf_dir):
    return re_.site_index(regions(spark, sf_dir))


@query(f"with {INDEX} select * from ix")
def a1_site_sketches(spark, sf_dir):
    """The index from sets of pages, kept for two days and added up."""
    told = regions(spark, sf_dir)
    first, second = (re_.site_sketches(told.filter(f"page_id % 2 = {d}")) for d in (0, 1))
    return re_.sketched_index(re_.merge_sketches(first, second))


@query(f"""with {INDEX}, sp as (select site, count(distinct page_id) as site_pages from r group by site)
select page_id, idx, site_pages, (case when text_length < 6 then 0 else coalesce(repeat_pages, 0) end)::bigint as repeat_pages, site_pages >= 2 and text_length >= 6 and repeat_pages >= 2 as repeated, case when site_pages >= 2 and text_length >= 6 then repeat_pages::double / site_pages else 0.0 end as repeat_frac
from r join sp using (site) left join ix using (site, signature)""")
def j1_repetition(spark, sf_dir):
    out = re_.with_repetition(regions(spark, sf_dir))
    return out.select("page_id", "idx", "site_pages", F.col("repeat_pages").cast("long").alias("repeat_pages"), "repeated", F.col("repeat_frac").cast("double").alias("repeat_frac"))


@query(f"""select page_id, idx, lag(tag) over w as prev_tag, lead(tag) over w as next_tag, coalesce(lag(text_length) over w, -1) as prev_length, coalesce(lead(text_length) over w, -1) as next_length,
idx::double / greatest(count(*) over (partition by page_id) - 1, 1) as pos, idx = 0 as first, idx = count(*) over (partition by page_id) - 1 as last,
not coalesce(bool_or((tag = 'p' or paragraphs >= 1) and text_length >= 300 and link_ratio < 0.3) over (partition by page_id order by idx rows between unbounded preceding and 1 preceding), false) as first_prose,
coalesce(bool_or(tag = 'h1' or (headings >= 1 and text_length < 160)) over (partition by page_id order by idx rows between 3 preceding and 1 preceding), false) as prev_titleish
from {regions_sql()} window w as (partition by page_id order by idx)""")
def w1_neighbours(spark, sf_dir):
    return re_.with_neighbours(regions(spark, sf_dir)).select("page_id", "idx", "prev_tag", "next_tag", "prev_length", "next_length", "pos", "first", "last", "first_prose", "prev_titleish")


BLOCK = """case when tag in ('h1', 'h2') then 'heading' when tag = 'ul' then case when link_ratio >= 0.6 then 'links' else 'list' end when text_length = 0 then 'empty'
when link_ratio >= 0.6 and links >= 3 then 'links' when paragraphs >= 1 or text_length >= 120 then 'prose' when headings >= 1 and text_length < 80 then 'heading' else 'mixed' end"""


def axes_sql(source: str, kind: str) -> str:
    return f"""(select * exclude (tblock, tslot, opens, structural, starts, section), case when structural then coalesce(first_value(case when opens then tslot end ignore nulls) over s, case when regexp_matches(first_value(landmark) over s, 'main|article') then 'article' else 'page' end) else coalesce(tslot, {kind}) end as slot
from (select *, sum(starts) over (partition by page_id order by idx) as section from (select *, ((block = 'heading' and structural) or idx = 0 or landmark is distinct from lag(landmark) over (partition by page_id order by idx))::int as starts
from (select d.*, t.structural, t.block as tblock, t.slot as tslot, t.opens, coalesce(t.block, {BLOCK}) as block from {source} d left join {types_sql()} t on t.type = d.{kind})))
window s as (partition by page_id, section order by idx rows between unbounded preceding and unbounded following))"""


@query(f"select page_id, idx, final, block, slot from {axes_sql(labelled_sql(), 'final')}")
def w4_axes(spark, sf_dir):
    return re_.derive_axes(labelled(spark, sf_dir), "final").select("page_id", "idx", "final", "block", "slot")


@query(f"select page_id, idx, {BLOCK} as block from {regions_sql()}")
def f12_structural_block(spark, sf_dir):
    return regions(spark, sf_dir).select("page_id", "idx", re_.structural_block().alias("block"))


@query(f"select page_id, idx, case when (page_id + idx) % 7 = 3 then 'media' else {BLOCK} end as block from {regions_sql()}")
def f12_framed_block(spark, sf_dir):
    """Every seventh region holds a frame."""
    framed = regions(spark, sf_dir).withColumn("frame_host", F.expr("case when (page_id + idx) % 7 = 3 then 'player.example' end"))
    return framed.select("page_id", "idx", re_.structural_block(re_.has_frame(framed)).alias("block"))


# ---------------------------------------------------------------- label runs

RUN = label_run_sql("one")
FLAGGED = f"(select *, confidence < 0.5 or margin < 0.1 as flagged from {RUN})"
VERDICT = "case when (page_id + idx) % 5 = 0 then 'wrong:heading' when (page_id + idx) % 5 = 1 then 'either' when (page_id + idx) % 5 = 2 then 'unsure' else 'ok' end"


def judgements(spark, sf_dir):
    return regions(spark, sf_dir).filter("page_id % 3 = 0").select("page_id", "idx", F.expr(VERDICT).alias("verdict"))


def ranked_run(spark, sf_dir, run="one"):
    return la.flag_labels(la.rank_probabilities(label_run(spark, sf_dir, run)))


@query(f"select page_id, idx, choice, second, confidence, margin, flagged from {FLAGGED}")
def p14_rank_probabilities(spark, sf_dir):
    return ranked_run(spark, sf_dir).select("page_id", "idx", "choice", F.col("top")[1]["type"].alias("second"), "confidence", "margin", "flagged")


@query(f"select choice, count(*) as n, count(*) filter (flagged) as flagged, round(avg(confidence), 3) as mean_confidence from {FLAGGED} group by choice")
def a5_label_summary(spark, sf_dir):
    return la.label_summary(ranked_run(spark, sf_dir))


@query(f"with c as (select confidence as c, row_number() over (order by confidence) - 1 as k, count(*) over () as n from {RUN}) select min(c) filter (k >= least(n - 1, floor(n * 0.25))) as p25, min(c) filter (k >= least(n - 1, floor(n * 0.5))) as median, min(c) filter (k >= least(n - 1, floor(n * 0.75))) as p75 from c")
def a14_run_quantiles(spark, sf_dir):
    return la.ranked_quantiles(ranked_run(spark, sf_dir), "confidence", {"p25": 0.25, "median": 0.5, "p75": 0.75})


@query(f"select least(choice, second) as a, greatest(choice, second) as b, count(*) as n from {FLAGGED} where flagged group by 1, 2")
def a15_confused_pairs(spark, sf_dir):
    return la.confused_pairs(ranked_run(spark, sf_dir))


@query(f"""with x as (select url, left(text, 60) as key, arg_max(choice, seq) as ac, arg_max(confidence, seq) as af from {RUN} group by 1, 2), y as (select url, left(text, 60) as key, arg_max(choice, seq) as bc, arg_max(confidence, seq) as bf from {label_run_sql("two")} group by 1, 2)
select count(*) as paired, round(avg(bf - af), 4) as mean_delta, count(*) filter (bf - af > 0.1) as up, count(*) filter (bf - af < -0.1) as down, count(*) filter (ac <> bc) as relabelled, count(*) filter (af >= 0.5 and bf < 0.5) as newly_flagged, count(*) filter (af < 0.5 and bf >= 0.5) as unflagged from x join y using (url, key)""")
def j12_compare_runs(spark, sf_dir):
    return la.compare_runs(ranked_run(spark, sf_dir), ranked_run(spark, sf_dir, "two"))


@query(f"""with j as (select page_id, idx, {VERDICT} as v from {regions_sql()} where page_id % 3 = 0), m as (select flagged, split_part(v, ':', 1) as v from {FLAGGED} join j using (page_id, idx))
select flagged, count(*) as judged, count(*) filter (v = 'ok') as ok, count(*) filter (v = 'either') as "either", count(*) filter (v = 'wrong') as wrong, count(*) filter (v = 'unsure') as unsure from m group by flagged""")
def a13_review_score(spark, sf_dir):
    return la.review_score(ranked_run(spark, sf_dir), judgements(spark, sf_dir))


@query(f"""with j as (select page_id, idx, {VERDICT} as v from {regions_sql()} where page_id % 3 = 0),
v as (select f.*, case when v like 'wrong:%' then split_part(v, ':', 2) else choice end as fin, split_part(v, ':', 1) as review from {RUN} f left join j using (page_id, idx)),
p as (select *, case when regexp_matches(tag, '^h[1-6]$') and text_length < 40 and fin in ('related', 'trending') then 'heading-is-heading'
when fin = 'teaser_card' and coalesce(lag(text_length) over w < 40, false) and regexp_matches(lag(text) over w, '(?i)^(related|see also|more stories|up next)') then 'related-slot' end as policy from v window w as (partition by page_id order by idx))
select page_id, idx, review, policy, case policy when 'heading-is-heading' then 'heading' when 'related-slot' then 'related' else fin end as final from p""")
def j11_apply_review(spark, sf_dir):
    return apply_policies(la.apply_verdicts(ranked_run(spark, sf_dir), judgements(spark, sf_dir))).select("page_id", "idx", "review", "policy", "final")


@query(f"select page_id, idx, choice from {FLAGGED} where not flagged order by md5(page_id::varchar || ':' || idx::varchar || ':42'), page_id, idx limit 50")
def k4_review_sample(spark, sf_dir):
    return la.review_sample(ranked_run(spark, sf_dir), 50, 42).select("page_id", "idx", "choice")


@query(f"select type from {types_sql()} where type not in (select choice from {RUN})")
def u3_unused_types(spark, sf_dir):
    return la.unused_types(ranked_run(spark, sf_dir), types_table(spark))


@query(f"select page_id, count(*) as missing from {regions_sql()} where not (page_id % 2 = 0 and idx % 3 <> 0) group by page_id")
def u2_unlabelled(spark, sf_dir):
    r = regions(spark, sf_dir)
    return la.unlabelled(r, r.filter("page_id % 2 = 0 and idx % 3 <> 0")).groupBy("page_id").agg(F.count("*").alias("missing"))


@query(f"""select page_id, idx, text, lag(b) over w as before, lead(b) over w as after from (select *, tag || ': ' || left(regexp_replace(text, '[ \\n\\t]+', ' ', 'g'), 80) as b from {regions_sql()}) window w as (partition by page_id order by idx)""")
def w6_label_requests(spark, sf_dir):
    return la.label_requests(regions(spark, sf_dir))


@query(f"""with f as (select page_id, idx, site, unnest(list_filter([case when instr(text, '|') > 0 then 'pipes' end, case when instr(text, '@') > 0 then 'mail' end, case when instr(text, '!!') > 0 then 'shouting' end, case when text_length < 40 then 'short' end], lambda x: x is not null)) as flag, final from {labelled_sql()}),
t as (select flag, final, count(*) as c from f group by 1, 2), b as (select flag, sum(c)::bigint as matches, max(c) as top from t group by 1), k as (select t.flag, min(t.final) as type from t join b on t.flag = b.flag and t.c = b.top group by 1)
select b.flag, matches, (select count(distinct site) from f where f.flag = b.flag) as sites, type, round(top::double / matches, 3) as precision from b join k using (flag) where matches >= 5""")
def a6_audit_hints(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    tests = {"pipes": F.col("text").contains("|"), "mail": F.col("text").contains("@"), "shouting": F.col("text").contains("!!"), "short": F.col("text_length") < 40}
    flags = rows.select("page_id", "idx", "site", F.explode(F.filter(F.array(*(F.when(c, n) for n, c in tests.items())), lambda x: x.isNotNull())).alias("flag"))
    return la.audit_hints(flags, rows)


# ---------------------------------------------------------------- directories

SELECTED = f"(select *, {SELECTOR} as selector from {labelled_sql()})"


def directory_of(counts: str, keys: str) -> str:
    return f"""(select {keys}, n, best, type from (select {keys}, sum(c)::bigint as n, max(c) as best, arg_min(final, {{'c': -c, 't': final}}) as type from {counts} group by {keys}) where best::double / n >= 0.75)"""


@query(f"""with l as {SELECTED}, c as (select site, selector, final, count(*) as c from l group by 1, 2, 3), d as {directory_of('c', 'site, selector')}, p as (select site, selector, count(distinct page_id) as pages from l group by 1, 2)
select site, selector, type, n, round(best::double / n, 2) as purity, pages from d join p using (site, selector)""")
def a2_derive_directory(spark, sf_dir):
    return di.derive_directory(di.with_selector(labelled(spark, sf_dir)))


@query(f"""with l as {SELECTED}, c as (select site, selector, final, count(*) as c from l where site <> 'src1' group by 1, 2, 3), d as {directory_of('c', 'site, selector')}
select l.page_id, l.idx, d.type as directory_type from l left join d using (site, selector)""")
def j3_directory_calls(spark, sf_dir):
    rows = di.with_selector(labelled(spark, sf_dir))
    return di.directory_calls(rows, di.derive_directory(rows.filter("site <> 'src1'"))).select("page_id", "idx", "directory_type")


LOPO = f"""l as {SELECTED}, own as (select site, selector, page_id, final, count(*) as own from l group by 1, 2, 3, 4), tot as (select site, selector, final, sum(own)::bigint as c from own group by 1, 2, 3),
asked as (select distinct site, selector, page_id from l), lft as (select a.site, a.selector, a.page_id, t.final, t.c - coalesce(o.own, 0) as c from asked a join tot t using (site, selector) left join own o on o.site = a.site and o.selector = a.selector and o.page_id = a.page_id and o.final = t.final),
pos as (select * from lft where c > 0), lod as {directory_of('pos', 'site, selector, page_id')}, x as (select l.*, lod.type as directory_type from l left join lod using (site, selector, page_id))"""


@query(f"""with {LOPO} select site, count(*) as regions, count(directory_type) as covered, count(*) filter (directory_type = final) as right_covered, count(*) filter (x.type = final) as rules_right, count(*) filter (coalesce(directory_type, x.type) = final) as combined_right
from x group by site having count(distinct page_id) >= 2""")
def j15_directory_lopo(spark, sf_dir):
    return di.lopo_score(di.directory_lopo(di.with_selector(labelled(spark, sf_dir))))


TIERS = "(select doc_id as page_id, source as site, case when n_chars > 3000 then 'relayout' when n_chars > 800 then 'contained' else 'raw' end as tier, case when doc_id % 4 = 0 then 'article' else 'directory' end as kind from documents)"


def page_tiers(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.col("source").alias("site"), F.expr("case when n_chars > 3000 then 'relayout' when n_chars > 800 then 'contained' else 'raw' end").alias("tier"), F.expr("case when doc_id % 4 = 0 then 'article' else 'directory' end").alias("kind"))


@query(f"with c as (select site, tier, count(*) filter (kind <> 'directory') as h, count(*) as n from {TIERS} group by 1, 2) select site, arg_min(tier, {{'a': -h, 'b': case when h > 0 then 0 else -n end, 'c': tier}}) as tier from c group by site")
def a3_site_tiers(spark, sf_dir):
    return di.site_tiers(page_tiers(spark, sf_dir))


@query(f"""with c as (select site, tier, count(*) filter (kind <> 'directory') as h, count(*) as n from {TIERS} group by 1, 2), s as (select site, arg_min(tier, {{'a': -h, 'b': case when h > 0 then 0 else -n end, 'c': tier}}) as st from c where site <> 'src2' group by site),
x as (select page_id, site, st, case when page_id % 9 = 0 then 'raw' end as own, case when page_id % 6 = 0 then 'relayout' when page_id % 3 = 0 then 'contained' end as rt from {TIERS} left join s using (site))
select page_id, coalesce(own, rt, st, 'contained') as tier, case when own is not null then 'override' when rt is not null then 'rule' when st is not null then 'site' else 'default' end as reason from x""")
def j14_resolve_tier(spark, sf_dir):
    pages = page_tiers(spark, sf_dir)
    rules = pages.filter("page_id % 3 = 0").select("page_id", F.lit(1).alias("set_pos"), F.lit("contained").alias("tier")).union(pages.filter("page_id % 6 = 0").select("page_id", F.lit(2), F.lit("relayout")))
    own = pages.filter("page_id % 9 = 0").select("page_id", F.lit("raw").alias("tier"))
    return di.resolve_tier(pages.select("page_id", "site"), di.site_tiers(pages.filter("site <> 'src2'")), rules, own).select("page_id", "tier", "reason")


# ---------------------------------------------------------------- scoring

SCORED = f"""(select l.*, c.block as call_block, c.slot as call_slot, l.type = l.final as strict, l.type = l.final or (review = 'either' and l.type = runner_up) as lenient, l.block = c.block as block_ok, l.slot = c.slot as slot_ok, l.block = c.block and l.slot = c.slot as axes_ok,
case when {HASH01.replace('site', 'l.site')} < 0.25 then 'holdout' else 'dev' end as split from {axes_sql(labelled_sql(), 'final')} l join (select page_id, idx, block, slot from {axes_sql(labelled_sql(), 'type')}) c using (page_id, idx))"""
SCOPED = f"(select *, 'all' as scope from {SCORED} union all select *, split as scope from {SCORED})"
TYPE_SCORES = f"""(select scope, type, n::bigint as n, called::bigint as called, round(p, 3) as precision, round(r, 3) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 3) as f1 from (select *, case when called > 0 then tp::double / called else 0 end as p, case when n > 0 then tp::double / n else 0 end as r
from (select scope, type, sum(n) as n, sum(called) as called, sum(tp) as tp from (select scope, final as type, 1 as n, 0 as called, strict::int as tp from {SCOPED} union all select scope, type, 0, 1, 0 from {SCOPED}) group by 1, 2)))"""


def scored(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    truth = re_.derive_axes(rows, "final").select("page_id", "idx", "site", "final", "block", "slot", "review", "runner_up", "tree_type", "tree_conf")
    calls = re_.derive_axes(rows, "type").select("page_id", "idx", "type", "rule", F.col("block").alias("call_block"), F.col("slot").alias("call_slot"))
    return sc.scored_rows(truth, calls)


@query(f"select page_id, idx, strict, lenient, block_ok, slot_ok, axes_ok, split from {SCORED}")
def j16_scored_rows(spark, sf_dir):
    return scored(spark, sf_dir).select("page_id", "idx", "strict", "lenient", "block_ok", "slot_ok", "axes_ok", "split")


@query(f"select * from {TYPE_SCORES}")
def a7_type_scores(spark, sf_dir):
    return sc.type_scores(scored(spark, sf_dir))


@query(f"""select scope, count(*) as regions, round(avg(strict::int), 3) as strict, round(avg(lenient::int), 3) as lenient, round(avg(block_ok::int), 3) as block, round(avg(slot_ok::int), 3) as slot, round(avg(axes_ok::int), 3) as axes, any_value(m) as macro_f1
from {SCOPED} join (select scope, round(avg(f1), 3) as m from {TYPE_SCORES} where n >= 5 group by 1) using (scope) group by scope""")
def a7_score(spark, sf_dir):
    return sc.score(scored(spark, sf_dir))


@query(f"""with c as (select final, type, rule, count(*) as c from {SCORED} where not lenient group by 1, 2, 3) select final, type, sum(c)::bigint as n, string_agg(rule || ':' || c, ',' order by rule) as rules from c group by 1, 2 order by n desc, final, type limit 60""")
def a8_confusions(spark, sf_dir):
    return sc.confusions(scored(spark, sf_dir))


@query(f"select rule, count(*) as n, count(*) filter (lenient) as \"right\", round(count(*) filter (lenient)::double / count(*), 3) as share from {SCORED} group by rule having count(*) >= 10 order by share, n desc, rule limit 12")
def a9_rule_use(spark, sf_dir):
    return sc.least_reliable(sc.rule_use(scored(spark, sf_dir)))


@query(f"select page_id, split, count(*) as regions, round(avg(strict::int), 2) as strict from {SCORED} group by 1, 2")
def a10_page_scores(spark, sf_dir):
    return sc.page_scores(scored(spark, sf_dir))


@query(f"select slot, count(*) as n, count(*) filter (slot_ok) as ok from {SCORED} group by slot")
def a10_slot_scores(spark, sf_dir):
    return sc.slot_scores(scored(spark, sf_dir))


STACKED = f"with {LOPO}, s as (select *, case when tree_conf >= 0.7 then tree_type end as tree from x)"


def stacked(spark, sf_dir):
    return di.directory_lopo(di.with_selector(labelled(spark, sf_dir)))


@query(f"""{STACKED} select count(*) as n, count(*) filter (type = final) as rules, count(*) filter (coalesce(tree_type, type) = final) as trees, count(*) filter (coalesce(tree, type) = final) as trees_then_rules, count(directory_type) as covered, count(*) filter (directory_type = final) as directory_right, count(*) filter (coalesce(directory_type, tree, type) = final) as stack from s""")
def a18_stack_score(spark, sf_dir):
    return sc.stack_score(stacked(spark, sf_dir))


@query(f"""{STACKED} select page_id, idx, coalesce(directory_type, tree, type) as stack_type, case when directory_type is not null then 'directory' when tree is not null then 'trees' else 'rules' end as source, case when directory_type is null and tree is not null then tree_conf end as confidence from s""")
def j13_stack_calls(spark, sf_dir):
    return sc.stack_calls(stacked(spark, sf_dir)).select("page_id", "idx", "stack_type", "source", "confidence")


DISPOSED = f"""{STACKED}, k as (select *, coalesce(directory_type, tree, type) as st from s), t as {types_sql()}, d as (select k.*, a.disposition as truth, b.disposition as dr, c.disposition as ds, directory_type is not null or (tree_conf >= 0.8 and tree_type = st) as certain from k join t a on a.type = final join t b on b.type = k.type join t c on c.type = st),
v as (select 'rules' as variant, truth, dr as d from d union all select 'stack', truth, ds from d union all select 'careful', truth, case when ds = 'drop' and not coalesce(certain, false) then 'demote' else ds end from d)"""


@query(f"{DISPOSED} select variant, truth, count(*) filter (d = 'keep') as keep, count(*) filter (d = 'demote') as demote, count(*) filter (d = 'drop') as drop from v group by 1, 2")
def a11_disposition_score(spark, sf_dir):
    return sc.disposition_score(stacked(spark, sf_dir))


@query(f"select threshold, count(*) as n, count(*) filter (case when tree_conf >= threshold then tree_type else type end = final) as \"right\" from {labelled_sql()}, (select unnest([0.0, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::double as threshold) group by threshold")
def a12_blend_sweep(spark, sf_dir):
    return sc.blend_sweep(labelled(spark, sf_dir))


@query(f"""with a as {TYPE_SCORES}, b as (select scope, type, f1 as f1_before from {TYPE_SCORES.replace('final as type', "case when final = 'ad' then 'text' else final end as type")} where type <> 'sponsored')
select scope, type, f1, f1_before, round(f1 - f1_before, 3) as delta, coalesce(n >= 5 and round(f1 - f1_before, 3) < -0.05, false) as regressed from a full join b using (scope, type)""")
def a19_scorecard_diff(spark, sf_dir):
    rows = scored(spark, sf_dir)
    before = sc.type_scores(rows.withColumn("final", F.when(F.col("final") == "ad", "text").otherwise(F.col("final")))).filter("type <> 'sponsored'")
    return sc.scorecard_diff(sc.type_scores(rows), before)


@query(f"""{STACKED}, k as (select *, coalesce(directory_type, tree, type) as st, case when directory_type is not null then 'directory' when tree is not null then 'trees' else 'rules' end as source from s),
d as (select k.*, t.disposition as plain, t.disposition = 'drop' and not (source = 'directory' or (source = 'trees' and tree_conf >= 0.8)) as softened from k join {types_sql()} t on t.type = st), e as (select *, case when softened then 'demote' else plain end as dd from d)
select page_id, count(*) as total, count(*) filter (dd = 'keep') as keep, count(*) filter (dd = 'demote') as demote, count(*) filter (dd = 'drop') as drop, count(*) filter (source = 'rules') as from_rules, count(*) filter (source = 'trees') as from_trees, count(*) filter (source = 'directory') as from_directory, count(*) filter (softened) as softened from e group by page_id""")
def a17_page_counts(spark, sf_dir):
    calls = sc.stack_calls(stacked(spark, sf_dir))
    return re_.page_counts(re_.with_disposition(calls, "stack_type"))


@query(f"""{STACKED}, c as (select l.page_id, l.idx, l.text, l.final as t, l.block from {axes_sql(labelled_sql(), 'final')} l), d as (select c.*, t.disposition as d from c join {types_sql()} t on t.type = c.t),
g as (select *, case when d = 'keep' and block = 'cards' and coalesce(lag(d = 'keep' and block = 'cards') over (partition by page_id, d order by idx), false) then 0 else 1 end as new from d)
select page_id, count(*) filter (d = 'keep') as kept, sum(new) filter (d = 'keep')::bigint as groups, count(*) filter (d = 'demote') as aside, coalesce(string_agg(t || ':' || left(text, 90), ',' order by idx) filter (d = 'drop'), '') as dropped from g group by page_id""")
def w9_assemble_pages(spark, sf_dir):
    rows = re_.derive_axes(labelled(spark, sf_dir), "final").drop("type").withColumnRenamed("final", "type")
    types = F.broadcast(types_table(spark).select("type", "disposition"))
    page = re_.assemble_pages(rows.join(types, "type"))
    told = F.array_join(F.transform("dropped", lambda x: F.concat_ws(":", x["type"], x["snippet"])), ",")
    groups = F.size(F.array_distinct(F.transform("body", lambda x: x["grp"]))).cast("long")
    return page.select("page_id", F.size("body").cast("long").alias("kept"), F.when(F.size("body") > 0, groups).alias("groups"), F.size("aside").cast("long").alias("aside"), told.alias("dropped"))


# ---------------------------------------------------------------- requests

SETS = ((0, "news", True, "*://www.site*.example.com/news/*"), (1, "shop", True, "*.example.com/shop/*"), (2, "off", False, "<all_urls>"), (3, "all", True, "<all_urls>"))
REDIRECTS = ((0, 0, "https://cdn.example.org/*/banner/*", "https://mirror.example.org/$1/plain/$2"), (1, 0, "https://cdn.example.org/*", "https://cdn.example.org/$1"))
BLOCKS = ((0, 0, "*/click/*banner*"), (3, 0, "*://ads.tracker.example/error/*"))
LINES = ((0, False, "||ads.tracker.example^$script"), (1, False, "/banner/x.js$image"), (2, False, "@@||ads.tracker.example^$domain=site3.example.com"), (3, True, "/signup/*"), (4, False, "! note"), (5, False, "##.ad"), (6, False, "site1.example.com##.promo"), (7, True, "example.com##.nag"), (8, False, "||x.example^$websocket"))
DOMAINS = (("site5.example.com",), ("site1.example.com",))


def rule_tables(spark):
    return (
        spark.createDataFrame(SETS, "set_pos int, name string, enabled boolean, pattern string"),
        spark.createDataFrame(REDIRECTS, "set_pos int, pos int, `from` string, `to` string"),
        spark.createDataFrame(BLOCKS, "set_pos int, pos int, pattern string"),
    )


def decided(spark, sf_dir):
    match, redirect, block = rule_tables(spark)
    lines = spark.createDataFrame(LINES, "pos int, custom boolean, line string")
    return rq.decide_requests(requests(spark, sf_dir), match, redirect, block, rq.parse_filters(lines)[0], spark.createDataFrame(DOMAINS, "domain string"))


# The same decisions by the meaning of those rules.
DECIDED = rf"""(with q as (select *, page_url like '%.example.com/news/%' as news, page_url like '%.example.com/shop/%' as shop, regexp_extract(url, '^https://([^/]*)', 1) as h, regexp_replace(regexp_extract(page_url, '^https://([^/]*)', 1), '^www\.', '') as ph from {REQUESTS_SQL}),
r as (select *, case when news and url like 'https://cdn.example.org/%/banner/%' then regexp_replace(url, '^https://cdn\.example\.org/(.*)/banner/(.*)$', 'https://mirror.example.org/\1/plain/\2') end as target,
news and url like '%/click/%banner%' as b0, url like '%://ads.tracker.example/error/%' as b3,
type <> 'document' and url like '%/signup/%' as f3, type <> 'document' and h = 'ads.tracker.example' and ph = 'site3.example.com' as fx, type <> 'document' and h = 'ads.tracker.example' and type = 'script' as f0, type <> 'document' and url like '%/banner/x.js%' and type = 'image' as f1,
ph = 'site5.example.com' or ph = 'site1.example.com' as allowed from q)
select request_id, tab_id, ts, target, case when target is not null then 'redirect' when b0 or b3 then 'block' when not allowed and (f3 or (not fx and (f0 or f1))) then 'block' else 'allow' end as decision,
case when target is not null then 'news' when b0 then 'news' when b3 then 'all' when not allowed and (f3 or (not fx and (f0 or f1))) then 'filters' end as decided_by from r)"""


@query(f"select request_id, decision, target, decided_by from {DECIDED}")
def j5_decide_requests(spark, sf_dir):
    return decided(spark, sf_dir).select("request_id", "decision", "target", "decided_by")


@query(f"select coalesce(decided_by, '-') as decided_by, count(*) as requests, count(*) filter (decision = 'block') as blocked, count(*) filter (decision = 'redirect') as redirected from {DECIDED} group by 1")
def a16_filter_hits(spark, sf_dir):
    return rq.filter_hits(decided(spark, sf_dir))


@query(f"""with p as (select distinct page_url from {REQUESTS_SQL}) select page_url, 0 as set_pos, 'news' as name from p where page_url like '%://www.site%.example.com/news/%' union all select page_url, 1, 'shop' from p where page_url like '%.example.com/shop/%' union all select page_url, 3, 'all' from p""")
def j4_match_rule_sets(spark, sf_dir):
    return rq.match_rule_sets(requests(spark, sf_dir), rule_tables(spark)[0])


@query(rf"select request_id from (select request_id, regexp_replace(regexp_extract(page_url, '^https://([^/]*)', 1), '^www\.', '') as ph from {REQUESTS_SQL}) where ph in ('site5.example.com', 'site1.example.com')")
def j6_allowlisted(spark, sf_dir):
    return rq.allowlisted(requests(spark, sf_dir), spark.createDataFrame(DOMAINS, "domain string")).select("request_id")


@query(rf"""with p as (select distinct page_url as url, regexp_replace(regexp_extract(page_url, '^https://([^/]*)', 1), '^www\.', '') as h from {REQUESTS_SQL}) select url as page_id, '.nag,.ad' || case when h = 'site1.example.com' then ',.promo' else '' end as selectors from p""")
def j8_cosmetic_selectors(spark, sf_dir):
    pages = requests(spark, sf_dir).select(F.col("page_url").alias("page_id"), F.col("page_url").alias("url")).distinct()
    lines = spark.createDataFrame(LINES, "pos int, custom boolean, line string")
    return rq.cosmetic_selectors(pages, rq.parse_cosmetics(lines)).withColumn("selectors", F.array_join("selectors", ","))


@query(f"""with p as (select distinct page_url from {REQUESTS_SQL}) select page_url, case when page_url like '%/news/%' then 'news,all' else 'shop,all' end as sets, case when page_url like '%/news/%' then '.a{{}}' || chr(10) || '.c{{}}' else '.c{{}}' end as css from p""")
def j9_rule_payload(spark, sf_dir):
    css = spark.createDataFrame([(0, ".a{}"), (3, ".c{}")], "set_pos int, css string")
    return rq.rule_payload(requests(spark, sf_dir), rule_tables(spark)[0], css).drop("payload")


@query(f"""with h as (select *, row_number() over (partition by tab_id order by ts desc, request_id desc) as k from {REQUESTS_SQL}) select tab_id, request_id, (row_number() over (partition by tab_id order by ts desc, request_id desc))::int as place from h where k <= 400 and regexp_matches(url, 'banner') qualify place <= 20""")
def w10_recent_requests(spark, sf_dir):
    return rq.recent_requests(requests(spark, sf_dir), "banner", 20).select("tab_id", "request_id", "place")


@query(f"""with n as (select *, sum(navigation::int) over (partition by tab_id order by ts, request_id) as nav_no from {REQUESTS_SQL}) select tab_id, nav_no::bigint as nav_no, count(*) as requests, count(*) filter (blocked) as blocked from n where not navigation group by 1, 2""")
def t2_tab_counters(spark, sf_dir):
    return rq.tab_counters(requests(spark, sf_dir).withColumnRenamed("request_id", "event_id"))


@query(f"""select tab_id, time_bucket(interval '1 hour', ts) as window_start, count(*) as blocked from {REQUESTS_SQL} where blocked group by 1, 2""")
def t3_blocked_updates(spark, sf_dir):
    return rq.blocked_updates(requests(spark, sf_dir), "1 hour")


@query(f"""select tab_id, make_timestamp(epoch_us(ts) - epoch_us(ts) % 600000) as window_start, count(*) as blocked from {REQUESTS_SQL} where blocked group by 1, 2""")
def t3_blocked_updates_600ms(spark, sf_dir):
    """Each event comes three times, as a source that repeats itself sends it; late and repeated rows count once."""
    told = requests(spark, sf_dir)
    again = told.unionByName(told).unionByName(told)
    return rq.blocked_updates(again.dropDuplicates(["request_id"]))


@query(rf"""with n as (select request_id, tab_id, ts, title, regexp_replace(regexp_replace(page_url, '[?#].*$', ''), '/page/[0-9]+/?$', '/') as p from {REQUESTS_SQL} where navigation), c as (select *, lag(p) over w as lp, lag(title) over w as lt, row_number() over w as k from n window w as (partition by tab_id order by ts, request_id))
select tab_id, request_id as nav_id, title from c where k = 1 or p is distinct from lp or title is distinct from lt""")
def t4_document_changes(spark, sf_dir):
    navs = requests(spark, sf_dir).filter("navigation").select(F.col("request_id").alias("nav_id"), "tab_id", "ts", F.col("page_url").alias("url"), "title")
    return rq.document_changes(navs).select("tab_id", "nav_id", "title")


@query("""with l as (select doc_id, source as site, case when n_chars > 3000 then 'relayout' else 'contained' end as tier, n_chars from documents) select tier, count(*) as listed, count(*) filter (doc_id % 5 <> 0) as captured, count(distinct site) as sites, coalesce(sum(n_chars) filter (doc_id % 5 <> 0), 0)::bigint as regions from l group by tier""")
def a4_capture_manifest(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    listed = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("site"), F.expr("case when n_chars > 3000 then 'relayout' else 'contained' end").alias("tier"))
    return li.capture_manifest(docs.filter("doc_id % 5 <> 0").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("regions")), listed)


# ---------------------------------------------------------------- pages to blocks, and trees


@query()
def p1_page_regions(spark, sf_dir):
    return extract_regions(read(spark, sf_dir, "pages"))


@query()
def p6_page_text(spark, sf_dir):
    return page_text(read(spark, sf_dir, "pages"))


@query()
def x1_rule_cascade(spark, sf_dir):
    return classify_pages(read(spark, sf_dir, "pages")).select("page_id", "idx", "type", "rule", "block", "slot", "disposition", "softened")


@query()
def flagship_page_blocks(spark, sf_dir):
    return page_blocks(read(spark, sf_dir, "pages"))


@query()
def flagship_learned_stack(spark, sf_dir):
    """The whole stack on the odd pages: rules, and trees and a directory that are made from the rules' calls on the even ones."""
    return count_blocks(learned_stack(read(spark, sf_dir, "pages"), F.pmod("page_id", F.lit(2)) == 0)[0])


@query()
def x5_boosted_trees(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").alias("features"))
    model = trees.train(rows, "label", 64)
    return trees.predict(rows, model).select("vec_id", "label", "tree_type", "tree_conf")


def embedded(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").alias("features"))


@query("""select feature, threshold from (select distinct feature, values_[(b * n // 32 + 1)::bigint] as threshold from (
select feature, list_sort(list(v)) as values_, count(*) as n from (select embedding[feature + 1]::double + 0.0 as v, feature from embeddings, (select unnest(range(64)) as feature)) group by feature), (select unnest(range(1, 32)) as b))""")
def x4_bin_thresholds(spark, sf_dir):
    found = trees.fit_bins(embedded(spark, sf_dir), 64)
    return spark.createDataFrame([(f, t) for f, own in enumerate(found) for t in own], "feature long, threshold double")


@query()
def x7_out_of_fold(spark, sf_dir):
    """Calls of every row by the trees of the other folds; three folds, grown in one pass."""
    return trees.cross_validate(embedded(spark, sf_dir), "label", 64, 3, F.pmod("vec_id", F.lit(3)), trees.Options(rounds=20)).select("vec_id", "label", "tree_type", "tree_conf")


@query()
def s9_model_card(spark, sf_dir):
    """A final model, saved and read again: its classes, features, options and the scores on rows kept back."""
    _, final = trees.holdout_fit(embedded(spark, sf_dir), "label", 64, F.pmod("vec_id", F.lit(4)) == 0, trees.Options(rounds=20), names=[f"e{i}" for i in range(64)])
    path = page_queries.own_folder(spark, "model")
    files.save_model(spark, final.to_json(), path)
    again = trees.Model.from_json(files.load_model(spark, path))
    held = again.holdout
    return spark.createDataFrame([(again.classes, again.names, again.options["rounds"], len(again.trees), held["n"], held["trees"])], "classes array<string>, features array<string>, rounds int, grown int, held_out long, right long")


from . import page_queries, registry_queries, report_queries, stream_queries  # noqa: E402  register further queries

page_queries.register(query)
report_queries.register(query)
registry_queries.register(query)
stream_queries.register(query)
