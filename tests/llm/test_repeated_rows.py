"""Hot ids and rows repeated very often: bounded ranges, a bounded fit, queries of one id."""

from collections import Counter

import numpy as np
import pytest

from blockyard.llm import ann, pfair_mix, weak_labels

DOCS = "doc_id long, source string, text string"


def checked(rows, got, columns):
    """Every row has a place, blocks are whole, and each source keeps to its own blocks."""
    assert Counter(tuple(r[c] for c in columns) for r in got) == Counter(rows)
    places = [r["mix_position"] for r in got]
    assert len(set(places)) == len(places)
    own = {}
    for r in got:
        own.setdefault(r["mix_slot"], set()).add(r["source"])
    assert all(len(s) == 1 for s in own.values()) and sorted(own) == list(range(len(own)))


def test_half_without_id_and_one_row_repeated(spark):
    rows = [(None, "a", f"text {i}") for i in range(3000)] + [(i, "ab"[i % 2], f"other {i}") for i in range(2000)] + [(7, "b", "again and again")] * 2500 + [(None, None, None)] * 700
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    got = pfair_mix.mix(df, block_docs=8, bucket_docs=200).collect()
    checked([(d, s, t) for d, s, t in rows], got, ("doc_id", "source", "text"))
    for source in "ab":
        slots = sorted(r["mix_position"] for r in got if r["source"] == source)
        first = [p for p in slots if p < slots[-1] - 8]
        assert len({p // 8 for p in first}) * 8 - len(first) < 8  # only a source's last block may be short
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, pfair_mix.mix(df.repartition(3), block_docs=8, bucket_docs=200).collect()), key=str)


def test_ranges_stay_small(spark, monkeypatch):
    """Half of the ids are null: with a digest of the text no range of hashes holds more than twice its share."""
    from pyspark.sql import functions as F

    df = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.lit("a").alias("source"), F.xxhash64("id").alias("digest"))
    got = pfair_mix.mix(df, bucket_docs=1000).select(F.floor((F.xxhash64("doc_id", "source", "digest", F.lit(7)) / float(1 << 64) + 0.5) * 40).alias("b")).groupBy("b").count().collect()
    assert max(r["count"] for r in got) < 2000 and sum(r["count"] for r in got) == 40_000


@pytest.mark.parametrize("copies", [1, 50_000])
def test_fit_weighs_a_repeated_row_once(spark, copies, monkeypatch):
    rows = [(i, " ".join(f"w{(i * 7 + j) % 40}" for j in range(30))) for i in range(300)]
    held = []
    train = weak_labels._train
    monkeypatch.setattr(weak_labels, "_train", lambda s, *a: held.append(s.count()) or train(s, *a))
    df = spark.createDataFrame(rows, "doc_id long, text string").union(spark.range(copies).selectExpr("cast(1 as long)", "'the same text as ever'"))
    assert weak_labels.quality_classifier(df, sample=10_000, rounds=2).count() == 300 + copies
    assert held[0] <= 301


def test_queries_of_one_id(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(size=6)]) for i in range(101, 160)]
    rows += [(100, [0.5] * 6), (100, [-0.5] * 6), (100, [-0.5] * 6), (200, [0.5] * 6)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5).collect()
    assert Counter(r["query_id"] for r in got) == {100: 10, 200: 5}
    kept = list({(i, tuple(v)) for i, v in rows})
    want = Counter()
    for i, v in kept:
        if i % 100 == 0:
            near = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), j) for j, w in kept if (j, w) != (i, v))[:5]
            want.update((i, rank, j, round(d, 9)) for rank, (d, j) in enumerate(near, 1))
    assert Counter((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got) == want
