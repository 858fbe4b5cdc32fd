"""Registered queries of the streaming jobs and of files: the events are read as a stream, what it writes is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import directory as di
from ..sources import files
from ..sources.shared import materialise
from ..streaming import jobs
from .derived import REQUEST, REQUESTS_SQL, labelled
from .page_queries import SITE, own_folder

RULES = (
    {"match": ["*/news/*"], "block": ["*/banner/*"]},
    {"match": ["*/shop/*"], "redirect": [{"from": "https://cdn.example.org/*", "to": "https://own.example/$1"}]},
    {"match": ["*"], "block": ["*"], "enabled": False},
)
KEPT = 50


def streamed(spark, sf_dir):
    """The events table as a stream of page requests."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    e = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    return e.select(F.col("event_id").alias("request_id"), F.col("user_id").alias("tab_id"), F.col("ts").cast("timestamp").alias("ts"), *(F.expr(x).alias(n) for n, x in REQUEST.items()))


def register(query) -> None:
    from .queries import SELECTED, directory_of

    @query(rf"""select request_id, case when page_url like '%/news/%' and url like '%/banner/%' then 'block' when page_url like '%/shop/%' and url like 'https://cdn.example.org/%' then 'redirect' else 'allow' end as decision,
    case when page_url like '%/shop/%' and url like 'https://cdn.example.org/%' then 'https://own.example/' || substr(url, length('https://cdn.example.org/') + 1) end as target from {REQUESTS_SQL}""")
    def t1_decide_stream(spark, sf_dir):
        folder = own_folder(spark, "decisions")
        schema = "match array<string>, block array<string>, redirect array<struct<from:string,to:string>>, enabled boolean"
        rows = [(r["match"], r.get("block"), r.get("redirect"), r.get("enabled", True)) for r in RULES]
        spark.createDataFrame(rows, schema).repartition(len(rows)).write.option("maxRecordsPerFile", 1).json(f"{folder}/rules")
        jobs.decide_requests_stream(streamed(spark, sf_dir), f"{folder}/rules", f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
        return spark.read.parquet(f"{folder}/out").select("request_id", "decision", "target")

    @query(f"""with h as (select *, row_number() over (partition by tab_id order by ts desc, request_id desc) as k from {REQUESTS_SQL}) select tab_id, count(*) as kept, string_agg(request_id::varchar, ',' order by ts, request_id) as ids from h where k <= {KEPT} group by tab_id""")
    def t5_recent_log(spark, sf_dir):
        rows = jobs.run_available(jobs.recent_log_stream(streamed(spark, sf_dir).select("request_id", "tab_id", "ts"), KEPT), own_folder(spark, "log"), "update")
        last = rows.groupBy("tab_id").agg(F.max_by("ids", "batch").alias("ids"))
        return last.select("tab_id", F.size("ids").cast("long").alias("kept"), F.array_join("ids", ",").alias("ids"))

    @query(f"select {SITE} as title, count(distinct url) as patterns from pages group by 1 union all select 'bad', 1")
    def s3_read_rule_sets(spark, sf_dir):
        path = own_folder(spark, "rule-files")
        sets = files.read_pages(spark, f"{sf_dir}/pages.parquet").groupBy(F.col("site").alias("title")).agg(F.collect_set("url").alias("match"))
        sets.write.option("maxRecordsPerFile", 1).json(path)
        spark.createDataFrame([('{"match": [',)], "value string").coalesce(1).write.mode("append").text(path)
        good, bad = files.read_rule_sets(spark, path)
        return good.select("title", F.size("match").cast("long").alias("patterns")).union(bad.select(F.lit("bad"), F.lit(1).cast("long")))

    half = f"(select * from {SELECTED} where page_id % 2 = 0 and site <> 'src1')"
    entries = lambda rows: directory_of(f"(select site, selector, final, count(*) as c from {rows} group by 1, 2, 3)", "site, selector")

    @query(f"""with e as {entries(SELECTED)}, d as {entries(half)} select site, selector, type, concat('kept by ', site) as owner from (select site, selector, type from d union all select site, selector, type from e where site not in (select site from d))""")
    def s7_merge_directory(spark, sf_dir):
        rows, path = di.with_selector(labelled(spark, sf_dir)), own_folder(spark, "directory")
        existing = di.derive_directory(rows).select("site", "selector", "type", F.concat(F.lit("kept by "), F.col("site")).alias("owner"))
        files.write_directory(existing, path)
        derived = di.derive_directory(rows.filter("page_id % 2 = 0 and site <> 'src1'")).select("site", "selector", "type")
        schema = existing.schema
        merged = materialise(di.merge_directory(spark.read.schema(schema).parquet(path), derived), "directory")
        files.write_directory(merged, path)
        return spark.read.schema(schema).parquet(path)
