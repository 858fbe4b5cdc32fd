"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .bpe import PATTERN, encode_decode, with_digests
from .centroid_clusters import cluster
from .chat_rotation import rotate
from .importance_sampling import importance_resample
from .interpolated_lm import score_texts
from .jaccard_join import jaccard_join
from .personal_data import find_personal, personal_digests
from .pfair_mix import mix
from .quality_rules import quality_rules
from .secret_scan import find_secrets, secret_digests
from .token_files import round_trip
from .weak_labels import quality_classifier


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    return str(path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("byte_bpe_50k.json"))
    return with_digests(coded).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op2_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_digests(find_secrets(docs, vocabulary("byte_bpe_50k.tiktoken"), PATTERN))


def op3_weak_label_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(table(spark, sf_dir, "documents"))


def op4_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(docs.select("doc_id", "source", F.xxhash64("text").alias("digest"))).drop("digest")


def op6_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.transform("mask", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string")))
    return rotate(table(spark, sf_dir, "conversations")).withColumn("mask", F.array_join(told, ","))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("digest", "lang")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return importance_resample(docs, table(spark, sf_dir, "benchmark"), with_text=False)


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings")).drop("n_measured")


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_digests(find_personal(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_lexicon": op1_bpe_lexicon,
    "op2_deleted_interpolation": op2_deleted_interpolation,
    "op3_weak_label_classifier": op3_weak_label_classifier,
    "op4_pfair_mix": op4_pfair_mix,
    "op6_chat_rotation": op6_chat_rotation,
    "op7_ann": op7_ann,
    "op5_secret_scan": op5_secret_scan,
    "op8_token_files": op8_token_files,
    "op9_quality_rules": op9_quality_rules,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_importance_resample": op11_importance_resample,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_personal_data": op13_personal_data,
}

#: Buckets of words by a CRC-32 register that goes over their bytes; distinct words only.
IMPORTANCE_SQL = r"""
with recursive bits as (
  select i, 0 as turn, i::bigint as v from range(256) t(i)
  union all select i, turn + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from bits where turn < 8),
steps as (select list(v order by i) as tab from bits where turn = 8),
words as (
  select 'd' as side, rowid as id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word
  from (select row_number() over () as rowid, text from documents)
  union all
  select 'b', 0, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) from benchmark),
coded as (
  select word, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, length(hex(encode(word))) // 2), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::bigint)),
    lambda c, b: xor(tab[xor(c & 255, b) + 1], c >> 8)), 4294967295) % 10000 as bucket
  from (select distinct word from words), steps),
told as (select side, id, bucket from words join coded using (word)),
counts as (select bucket, count(*) filter (side = 'd') as s, count(*) filter (side = 'b') as t from told group by bucket),
totals as (select coalesce(sum(s), 0)::double as s_all, coalesce(sum(t), 0)::double as t_all from counts),
gains as (select bucket, floor(1000 * ln((t + 1)::double * (s_all + 10000) / ((s + 1)::double * (t_all + 10000))))::bigint as gain
  from counts, totals),
weighed as (select id, count(*) as n_features, sum(gain)::bigint as weight from told join gains using (bucket) where side = 'd' group by id),
scored as (
  select doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
  from (select row_number() over () as id, doc_id from documents) left join weighed using (id)),
placed as (select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id nulls last, n_features) as place, count(*) filter (n_features >= 20) over () as able from scored)
select doc_id, n_features::bigint as n_features, weight, score, case when n_features >= 20 and place <= able * 10 // 100 then place end as rank from placed"""


def _clusters_sql() -> str:
    """The assignments of ``cluster``, one after the other, by full scans."""
    steps = [
        """kept as (select vec_id, v from (
  select vec_id, case when len(embedding) = 64 and not list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false)
    then list_transform(embedding, lambda x: floor(64 * x::double)::bigint) end as v from embeddings) where v is not null)""",
        "c0 as (select row_number() over (order by sha256('1:' || coalesce(vec_id::varchar, '')), v) - 1 as c, v as m from kept qualify c < 16)",
        "r as (select row_number() over () as id, vec_id, v from kept)",
    ]
    for turn in range(4):
        steps.append(f"""a{turn} as (select id, vec_id, v, c, d from (
  select id, vec_id, v, c, list_sum(list_transform(range(1, 65), lambda i: (v[i] - m[i]) * (v[i] - m[i])))::bigint as d from r, c{turn})
  qualify row_number() over (partition by id order by d, c) = 1)""")
        if turn < 3:
            steps.append(f"""c{turn + 1} as (select o.c, coalesce(n.m, o.m) as m from c{turn} o left join (
  select c, list(q order by i) as m from (
    select c, i, case when s >= 0 then s // n else -((-s + n - 1) // n) end as q from (
      select c, i, sum(v[i]) as s, count(*) as n from a{turn}, range(1, 65) t(i) group by c, i)) group by c) n on o.c = n.c)""")
    return "with " + ",\n".join(steps) + """
select vec_id, c::int as cluster, d as distance, (sum(d) over (partition by c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia,
  sha256(array_to_string(m, ',')) as centroid_sha256
from a3 join c3 using (c)"""


ORACLE_SQL: dict[str, str] = {
    "op11_importance_resample": IMPORTANCE_SQL,
    "op12_centroid_clusters": _clusters_sql(),
    "op6_chat_rotation": r"""
with t as (
  select conv_id, turn, floor(turn / 64)::bigint as chunk,
    replace(replace(coalesce(role, 'unknown'), '<|im_start|>', '< |im_start| >'), '<|im_end|>', '< |im_end| >') as role,
    replace(replace(coalesce(text, ''), '<|im_start|>', '< |im_start| >'), '<|im_end|>', '< |im_end| >') as text
  from conversations),
o as (select *, row_number() over (partition by conv_id, chunk order by turn nulls last, role, text) - 1 as pos from t),
p as (select distinct conv_id, role as speaker from t where role <> 'system'),
s as (
  select o.conv_id, speaker, chunk, floor(pos / 64)::bigint as part, pos, role = speaker as own,
    '<|im_start|>' || case when role = speaker then 'assistant' when role = 'system' then 'system' else 'user name=' || role end || chr(10) as head,
    text || '<|im_end|>' as body
  from o join p on o.conv_id = p.conv_id),
m as (select *, sum(length(head) + length(body) + 1) over (partition by conv_id, speaker, chunk, part order by pos) as stop from s)
select conv_id, speaker, chunk, part, count(*)::int as n_turns,
  string_agg(head || body || chr(10), '' order by pos) as rendered,
  coalesce(string_agg((stop - 1 - length(body))::bigint::varchar || ':' || (stop - 1)::bigint::varchar, ',' order by pos) filter (own), '') as mask
from m group by conv_id, speaker, chunk, part""",
}
