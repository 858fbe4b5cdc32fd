import json

import pytest
from pyspark.sql import functions as F

from blockyard.sources import files


def test_rule_sets_and_bad_files(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"match": ["*"], "block": ["*/x/*"], "redirect": [{"from": "a*", "to": "b$1"}]}))
    (tmp_path / "a.json").write_text('{"match": [')
    rules, bad = files.read_rule_sets(spark, str(tmp_path))
    assert [r["name"] for r in rules.collect()] == ["b"] and [r["name"] for r in bad.collect()] == ["a"]
    match, redirect, block = files.rule_tables(rules)
    assert match.count() == redirect.count() == block.count() == 1


def test_site_list_and_judgements(spark, tmp_path):
    (tmp_path / "sites.txt").write_text("www.a.example/x # note\n\n# only a note\nhttps://a.example/y\nb.example\n")
    got = {r["site"]: r["urls"] for r in files.read_site_list(spark, str(tmp_path / "sites.txt")).collect()}
    assert got == {"a.example": ["https://a.example/y", "https://www.a.example/x"], "b.example": ["https://b.example"]}
    (tmp_path / "j.json").write_text('{"p1:0": "ok", "p1:2": "wrong:heading"}')
    assert {tuple(r) for r in files.read_judgements(spark, str(tmp_path / "j.json")).collect()} == {("p1", 0, "ok"), ("p1", 2, "wrong:heading")}


def test_directory_and_scorecard(spark, tmp_path):
    kind = "site string, selector string, type string"
    files.write_directory(spark.createDataFrame([("a", "x", "text"), ("b", "y", "ad")], kind), str(tmp_path / "d"))
    files.write_directory(spark.createDataFrame([("a", "z", "list")], kind), str(tmp_path / "d"))
    assert {(r["site"], r["selector"]) for r in spark.read.parquet(str(tmp_path / "d")).collect()} == {("a", "z"), ("b", "y")}
    card = spark.createDataFrame([("all", 0.5)], "scope string, f1 double")
    assert files.write_scorecard(card, str(tmp_path / "s"), "r1") is None
    assert files.write_scorecard(card, str(tmp_path / "s"), "r2").first()["run_id"] == "r1"
    assert files.scorecard_history(spark, str(tmp_path / "s")).count() == 2
    assert files.write_scorecard(card, str(tmp_path / "s"), "r3", filtered=True) is None
    files.save_model(spark, {"k": [1.5]}, str(tmp_path / "m"))
    assert files.load_model(spark, str(tmp_path / "m")) == {"k": [1.5]}


def test_readers_see_a_whole_card_or_the_one_before(spark, tmp_path):
    path = str(tmp_path / "cards")
    assert files.published(spark, path) is None and files.scorecard_history(spark, path) is None
    old = spark.createDataFrame([("all", 0.5)], "scope string, f1 double")
    files.write_scorecard(old, path, "r1")
    reader = files.published(spark, path)
    broken = old.withColumn("f1", F.raise_error(F.lit("no card")).cast("double"))
    with pytest.raises(Exception, match="no card"):
        files.write_scorecard(broken, path, "r2")
    assert [tuple(r) for r in files.published(spark, path).collect()] == [("all", 0.5, "r1")]
    files.write_scorecard(old.withColumn("f1", F.lit(0.75)), path, "r3")
    assert reader.first()["f1"] == 0.5 and files.published(spark, path).first()["f1"] == 0.75
    assert [v[:2] for v in files.versions(spark, path)] == [(1, "r1"), (2, "r3")] and files.scorecard_history(spark, path).count() == 2


def test_published_directory_carries_other_sites_over(spark, tmp_path):
    kind = "site string, selector string, type string"
    files.publish_directory(spark.createDataFrame([("a", "x", "text"), ("b", "y", "ad")], kind), str(tmp_path / "d"))
    before = files.published(spark, str(tmp_path / "d"))
    files.publish_directory(spark.createDataFrame([("a", "z", "list")], kind), str(tmp_path / "d"))
    assert {tuple(r) for r in files.published(spark, str(tmp_path / "d")).collect()} == {("a", "z", "list"), ("b", "y", "ad")}
    assert before.count() == 2


def test_captures_are_packed_and_read_again(spark, tmp_path):
    rows = spark.range(1100).selectExpr("cast(id as string) as id", "concat('s', id % 3) as site", "cast(id as int) as regions", "id % 2 = 0 as domTruncated")
    files.write_captures(rows, str(tmp_path / "c"), per_file=100)
    assert 5 < len([f for f in (tmp_path / "c").iterdir() if f.name.startswith("part-")]) <= 11
    got = files.read_captures(spark, str(tmp_path / "c"), "part-*").select("id", "site", "regions", "domTruncated")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in rows.collect()} and got.count() == 1100
    files.write_captures(rows.limit(0), str(tmp_path / "none"))
    assert files.read_captures(spark, str(tmp_path / "none"), "part-*").count() == 0
