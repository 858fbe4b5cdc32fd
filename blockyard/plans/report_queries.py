"""Further registered queries: lists, totals and tables of label runs, reviews, scorecards, decisions and page documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.taxonomy import types_sql, types_table
from ..operators import labels as la
from ..operators import regions as re_
from ..operators import requests as rq
from ..operators import scoring as sc
from .derived import label_run_sql, labelled, labelled_sql, regions, regions_sql

PAGE_TITLE = "case when page_id % 5 = 0 then '' else concat('Document ', cast(page_id as {s})) end"
APPLICATION = "case when doc_id % 7 = 0 then null else (doc_id % 10) / 10.0 end"
WAIT = "(page_id * 131 + idx * 17) % 1000"
MESSAGE = "concat(upper(event_type), ' ', props)"
LEVEL = "case when event_id % 3 = 0 then 'error' when event_id % 3 = 1 then 'Warning' else 'info' end"
#: Calls with bylines and runs of cards, so that pages have every kind of group.
CALLED = "case when idx % 6 = 3 then 'byline' when idx % 6 in (1, 2, 4) then 'teaser_card' else final end"
WIDE = "cast(case when idx % 12 = 4 then 3 else 1 end as int)"


def register(query) -> None:
    from . import queries as q

    @query(f"""with x as (select url, left(text, 60) as key, arg_max(choice, seq) as a_choice, arg_max(confidence, seq) as a_conf from {label_run_sql("one")} group by 1, 2), y as (select url, left(text, 60) as key, arg_max(choice, seq) as b_choice, arg_max(confidence, seq) as b_conf from {label_run_sql("two")} group by 1, 2),
    d as (select *, round(b_conf - a_conf, 3) as delta from x join y using (url, key)) select * from (select case when delta < -0.15 then 'lost' when delta > 0.15 then 'gained' when a_choice <> b_choice then 'relabelled' end as kind, url, key, a_choice, a_conf, b_choice, b_conf, delta from d) where kind is not null""")
    def j12_moved_labels(spark, sf_dir):
        return la.moved_labels(q.ranked_run(spark, sf_dir), q.ranked_run(spark, sf_dir, "two"))

    @query(f"""select count(distinct page_id) as pages, count(*) as regions, count(*) filter (confidence < 0.5) as low_confidence, count(*) filter (margin < 0.1) as ties, count(*) filter (confidence < 0.5 or margin < 0.1) as "either" from {q.RUN}""")
    def a5_label_totals(spark, sf_dir):
        return la.label_totals(q.ranked_run(spark, sf_dir))

    @query(f"""with p as (select doc_id as page_id, case when n_chars > 3000 then 'relayout' when n_chars > 800 then 'contained' else 'raw' end as tier, {APPLICATION} as application from documents)
    select page_id, tier, application, coalesce((tier = 'contained' and application < 0.5) or (tier = 'relayout' and application > 0.5), false) as disagrees from p""")
    def a5_application_scores(spark, sf_dir):
        scores = q.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.expr(APPLICATION).cast("double").alias("application"))
        return la.application_scores(q.page_tiers(spark, sf_dir).join(scores, "page_id").select("page_id", "tier", "application"))

    @query(f"""with r as (select {WAIT} as ms, row_number() over (order by {WAIT}) - 1 as k, count(*) over () as n from {regions_sql()}) select min(ms) filter (k >= floor(n * 0.5)) as median, min(ms) filter (k >= floor(n * 0.9)) as p90 from r""")
    def a14_latency(spark, sf_dir):
        return la.latency_stats(regions(spark, sf_dir).select(F.expr(WAIT).alias("ms")))

    judged = f"""(select f.*, split_part(j.v, ':', 1) as kind, split_part(j.v, ':', 2) as should from {q.FLAGGED} f join (select page_id, idx, {q.VERDICT} as v from {regions_sql()} where page_id % 3 = 0) j using (page_id, idx))"""
    tally = ", ".join(f"count(*) filter (kind = '{k}') as \"{k}\"" for k in ("ok", "either", "wrong", "unsure"))

    @query(f"""with t as (select count(*) as judged, {tally} from {judged}) select *, round(ok / nullif(ok + "either" + wrong, 0), 3) as "right", round((ok + "either") / nullif(ok + "either" + wrong, 0), 3) as acceptable, round(wrong / nullif(ok + "either" + wrong, 0), 3) as wrong_share from t""")
    def a13_review_totals(spark, sf_dir):
        return la.review_totals(q.ranked_run(spark, sf_dir), q.judgements(spark, sf_dir))

    @query(f"select choice, count(*) as judged, {tally} from {judged} group by choice")
    def a13_review_by_type(spark, sf_dir):
        return la.review_by_type(q.ranked_run(spark, sf_dir), q.judgements(spark, sf_dir))

    @query(f"select choice, case when should = '' then '?' else should end as should, count(*) as n from {judged} where kind = 'wrong' group by 1, 2")
    def a13_review_confusions(spark, sf_dir):
        return la.review_confusions(q.ranked_run(spark, sf_dir), q.judgements(spark, sf_dir))

    where = "tag || ' in ' || landmark || ': '"

    @query(f"""with r as (select *, {where} || translate(left(text, 80), chr(10), ' ') as b from {regions_sql()}), t as (select page_id, idx, text, lag(b) over w as before, lead(b) over w as after from r window w as (partition by page_id order by idx))
    select page_id, idx, concat('doc:', page_id) as url, {PAGE_TITLE.format(s='varchar')} as title, text, before, after from t""")
    def w6_label_states(spark, sf_dir):
        pages = q.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id")).withColumns({"url": F.concat(F.lit("doc:"), F.col("page_id").cast("string")), "title": F.expr(PAGE_TITLE.format(s="string"))})
        return la.label_states(regions(spark, sf_dir), pages)

    @query(f"""select page_id, count(*) as regions, string_agg(tag || '(' || landmark || ') ' || text_length || 'ch ' || links || 'a ' || controls || 'ctl', '; ' order by idx) as summary from {regions_sql()} group by page_id""")
    def w6_page_summaries(spark, sf_dir):
        return la.page_summaries(regions(spark, sf_dir))

    @query(f"""select final, type, place, page_id, idx, rule, tag, translate(left(text, 80), chr(10), ' ') as snippet from (select *, (row_number() over (partition by final, type order by page_id, idx))::int as place from {labelled_sql()} where not (type = final or (review = 'either' and type = runner_up))) where place <= 4""")
    def a8_confusion_examples(spark, sf_dir):
        rows = labelled(spark, sf_dir)
        right = (F.col("type") == F.col("final")) | ((F.col("review") == "either") & (F.col("type") == F.col("runner_up")))
        return sc.confusion_examples(rows.withColumn("lenient", right))

    @query(f"""with a as (select scope, round(avg(strict::int), 3) as strict, round(avg(lenient::int), 3) as lenient, round(avg(block_ok::int), 3) as block, round(avg(slot_ok::int), 3) as slot, round(avg(axes_ok::int), 3) as axes, any_value(m) as macro_f1 from {q.SCOPED} join (select scope, round(avg(f1), 3) as m from {q.TYPE_SCORES} where n >= 5 group by 1) using (scope) group by scope),
    l as (unpivot a on strict, lenient, block, slot, axes, macro_f1 into name measure value value)
    select scope, measure, value, case when scope <> 'holdout' then value end as before, case when scope <> 'holdout' then 0.0::double end as delta from l""")
    def a19_headline_diff(spark, sf_dir):
        card = sc.score(q.scored(spark, sf_dir))
        return sc.headline_diff(card, card.filter("scope <> 'holdout'"))

    @query(f"select count(*) as checked, count(*) filter (decision = 'block') as blocked, count(*) filter (decision = 'redirect') as redirected from {q.DECIDED}")
    def a16_decision_totals(spark, sf_dir):
        return rq.decision_totals(q.decided(spark, sf_dir))

    @query(f"select page_url, count(*) as checked, count(*) filter (decision = 'block') as blocked from {q.DECIDED} join (select request_id, page_url from {q.REQUESTS_SQL}) using (request_id) group by page_url")
    def a16_blocked_per_page(spark, sf_dir):
        return rq.blocked_per_page(q.decided(spark, sf_dir))

    @query(f"""with m as (select event_id as message_id, user_id as tab_id, ts, {LEVEL} as level, {MESSAGE} as message from events), h as (select *, row_number() over (partition by tab_id order by ts desc, message_id desc) as k from m)
    select tab_id, message_id, level, message, (row_number() over (partition by tab_id order by ts desc, message_id desc))::int as place from h where k <= 400 and level = 'Warning' and regexp_matches(message, '(?i)view|click') qualify place <= 20""")
    def w10_recent_messages(spark, sf_dir):
        told = q.read(spark, sf_dir, "events").select(F.col("event_id").alias("message_id"), F.col("user_id").alias("tab_id"), "ts", F.expr(LEVEL).alias("level"), F.expr(MESSAGE).alias("message"))
        return rq.recent_messages(told, "warn", "view|click", 20).select("tab_id", "message_id", "level", "message", "place")

    called = f"(select * exclude (repeats), {CALLED} as called, {WIDE} as repeats from {labelled_sql()})"

    @query(f"""with a as (select page_id, idx, called as t, block, repeats from {q.axes_sql(called, 'called')}), d as (select a.*, y.disposition as d from a join {types_sql()} y on y.type = a.t),
    k as (select *, block = 'cards' and repeats = 1 as card from d where d = 'keep'), s as (select *, t = 'byline' and not card as byl, sum(case when card or t = 'byline' then 0 else 1 end) over (partition by page_id order by idx) as run from k),
    o as (select *, (card or byl) and coalesce(bool_or(card) over (partition by page_id, run order by idx rows between unbounded preceding and 1 preceding), false) as joins from s),
    g as (select *, sum(case when joins then 0 else 1 end) over (partition by page_id order by idx) as grp from o),
    b as (select page_id, string_agg(idx || ':' || grp || ':' || case when card then 'card' when byl and joins then 'card_byline' else 'block' end, ' ' order by idx) as body from g group by page_id)
    select p.page_id, coalesce(b.body, '') as body, case when not p.titled and {PAGE_TITLE.format(s='varchar')} <> '' then {PAGE_TITLE.format(s='varchar')} end as title from (select page_id, bool_or(t = 'title' and d <> 'drop') as titled from d group by page_id) p left join b using (page_id)""")
    def w9_page_documents(spark, sf_dir):
        rows = re_.derive_axes(labelled(spark, sf_dir).withColumns({"called": F.expr(CALLED), "repeats": F.expr(WIDE)}), "called").drop("type").withColumnRenamed("called", "type")
        calls = rows.join(F.broadcast(types_table(spark).select("type", "disposition")), "type")
        pages = q.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id")).withColumn("title", F.expr(PAGE_TITLE.format(s="string")))
        body = F.array_join(F.transform("body", lambda x: F.concat_ws(":", x["idx"], x["grp"], x["role"])), " ")
        return re_.assemble_pages(calls, pages).select("page_id", body.alias("body"), "title")
