"""The mix's order reaches the written files and the pipeline's last rows."""

from pyarrow import parquet

import corpus_pipeline
from blockyard.llm import pfair_mix

DOCS = "doc_id long, source string, text string"


def test_files_and_tokens_keep_the_order(spark, tmp_path):
    df = spark.createDataFrame([(i if i % 5 else None, "abc"[i % 7 % 3], f"text {i}") for i in range(700)], DOCS)
    want = [r["text"] for r in pfair_mix.mix(df, block_docs=4).orderBy("mix_position").collect()]
    pfair_mix.mixed(df, per_range=30, block_docs=4).write.parquet(str(tmp_path / "mixed"))
    files = sorted((tmp_path / "mixed").glob("part-*.parquet"))
    assert len(files) > 10
    assert [t for f in files for t in parquet.read_table(f).column("text").to_pylist()] == want
    want = {(r["doc_id"], r["mix_position"]) for r in pfair_mix.mix(df).collect()}
    got = [(r["doc_id"], r["mix_position"]) for r in corpus_pipeline.tokens(spark, df, "").collect()]
    assert len(got) == 700 and set(got) == want


def test_positions_are_those_of_the_files_that_the_mixing_stage_wrote(spark, tmp_path):
    df = spark.createDataFrame([(i, "abc"[i % 7 % 3], f"text {i}") for i in range(900)], DOCS)
    want = [r["doc_id"] for r in pfair_mix.mix(df, block_docs=4).orderBy("mix_position").collect()]
    pfair_mix.mixed(df, per_range=30, block_docs=4).write.parquet(str(tmp_path / "mixed"))
    df.coalesce(1).write.parquet(str(tmp_path / "plain"))
    at = lambda d: [r["doc_id"] for r in sorted(corpus_pipeline.tokens(spark, d, "").collect(), key=lambda r: r["mix_position"])]
    read = spark.read.parquet(str(tmp_path / "mixed"))
    assert at(read) == want and at(read.repartition(3)) == want
    assert at(spark.read.parquet(str(tmp_path / "plain"))) == list(range(900))  # another stage before gives another order


def test_rows_of_parts_of_files_have_no_place(spark, tmp_path):
    spark.range(100).selectExpr("id as doc_id", "'t' as text").coalesce(1).write.parquet(str(tmp_path / "d"))
    read = spark.read.parquet(str(tmp_path / "d"))
    assert pfair_mix.by_files(read.filter("doc_id % 2 = 1")) is None and pfair_mix.by_files(read.union(read)) is None and pfair_mix.by_files(spark.range(3)) is None
    assert {r["doc_id"]: r["mix_position"] for r in pfair_mix.by_files(read).collect()} == {i: i for i in range(100)}
    assert pfair_mix.by_files(read.limit(0)).count() == 0
