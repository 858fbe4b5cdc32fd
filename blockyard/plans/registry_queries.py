"""Registered queries of what a user may name, replace or leave out: lists of types and label policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.taxonomy import TYPE_LISTS, type_lists_sql, type_lists_table, with_type_list
from ..operators import labels as la
from ..operators.policies import POLICIES, Policy, apply_policies
from .derived import TYPES_BY_RUN, _fraction, label_run, regions_sql

#: A list of what readers came to read, and policies with one of the user's own first and one left out.
LISTS = with_type_list("reading", ("title", "heading", "text", "related"))
OWN = POLICIES.without("trending-slot").add(
    Policy("between-ads", "ad", lambda before, after: (F.col("final") == "text") & (F.col("text_length") < 200) & (before("final") == "ad") & (after("final") == "ad")),
    before="heading-is-heading",
)


def register(query) -> None:
    from . import queries as q

    @query(f"""with l as {type_lists_sql(LISTS)}, c as (select choice as type, count(*) as n from {q.RUN} group by 1)
    select list, count(*) as types, count(n) as used, (select sum(n)::bigint from c) as labels, ((select sum(n) from c) - coalesce(sum(n), 0))::bigint as outside from l left join c using (type) group by list""")
    def x2_type_lists(spark, sf_dir):
        return la.list_use(q.ranked_run(spark, sf_dir), type_lists_table(spark, LISTS))

    weight = lambda i: f"pow({_fraction(f'one{i}', False)}, 4)"
    inside = [i for i, t in enumerate(TYPES_BY_RUN) if t in LISTS["reading"]]
    rows = ", ".join(f"{{'p': {weight(i)} / ({' + '.join(map(weight, inside))}), 'type': '{TYPES_BY_RUN[i]}'}}" for i in inside)

    @query(f"""with r as (select page_id, idx, list_sort(list_transform([{rows}], lambda x: {{'by': -x.p, 'type': x.type}})) as r from {regions_sql()})
    select page_id, idx, r[1].type as choice, round(-r[1].by, 3) as confidence, round(r[2].by - r[1].by, 3) as margin from r""")
    def x2_within_types(spark, sf_dir):
        kept = la.within_types(label_run(spark, sf_dir, "one"), LISTS["reading"])
        return la.rank_probabilities(kept).select("page_id", "idx", "choice", "confidence", "margin")

    @query(f"""with p as (select *, case when choice = 'text' and text_length < 200 and lag(choice) over w = 'ad' and lead(choice) over w = 'ad' then 'between-ads'
    when regexp_matches(tag, '^h[1-6]$') and text_length < 40 and choice = 'related' then 'heading-is-heading'
    when choice = 'teaser_card' and lag(text_length) over w < 40 and regexp_matches(lag(text) over w, '(?i)^(related|see also|more stories|up next)') then 'related-slot' end as policy from {q.RUN} window w as (partition by page_id order by idx))
    select page_id, idx, policy, case policy when 'between-ads' then 'ad' when 'heading-is-heading' then 'heading' when 'related-slot' then 'related' else choice end as final from p""")
    def x2_policies(spark, sf_dir):
        labels = q.ranked_run(spark, sf_dir).withColumn("final", F.col("choice"))
        return apply_policies(labels, OWN).select("page_id", "idx", "policy", "final")
