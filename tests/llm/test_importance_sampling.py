"""Importance resampling against plain Python, and its odd cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from blockyard.llm import importance_sampling as imp

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def grams(text, max_n, buckets):
    words = WORD.findall((text or "").translate(LOWER))
    return [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, max_n + 1) for i in range(len(words) - n + 1)], len(words)


def plain(rows, target, percent=10, max_n=1, buckets=10_000, seed=2024, least=20):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(grams(text, max_n, buckets)[0])
    for text in target:
        t.update(grams(text, max_n, buckets)[0])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    out, able = [], []
    for doc_id, text in rows:
        found, words = grams(text, max_n, buckets)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append((doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
        able += [out[-1]] * (words >= least)
    won = sorted(able, key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))[: len(able) * percent // 100]
    left = Counter(out) - Counter(won)
    return sorted([(*r, i + 1) for i, r in enumerate(won)] + [(*r, None) for r in left.elements()], key=str)


def run(spark, rows, target, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = imp.importance_resample(docs, aim, with_text=False, **options)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("max_n", [1, 2])
def test_against_plain_python(spark, sf_dir, max_n):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert run(spark, rows, target, max_n=max_n) == plain(rows, target, max_n=max_n)


def test_null_ids_ties_repeats_and_odd_texts(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(["Éa", "b-c", "x9", "naïve", "w" * 90, "Z"]) for _ in range(n))
    rows = [(None, None), (None, ""), (1, "..."), *((None, text(30)) for _ in range(40)), *((7, text(25)) for _ in range(40)), *([(9, text(22))] * 60), (11, text(5000)), (12, "é" * 70_000)]
    for percent in (0, 35, 100):
        assert run(spark, rows, ["naïve x9 x9", None], percent=percent) == plain(rows, ["naïve x9 x9"], percent=percent)


def test_empty_tables_and_clashing_names(spark):
    assert run(spark, [], ["a"]) == []
    rows = [(i, "a b c d " * 6) for i in range(20)]
    assert run(spark, rows, []) == plain(rows, [])
    docs = spark.createDataFrame([(i, "a b c d " * 6, i, "x", 5) for i in range(20)], "doc_id long, text string, _row long, score string, _WORDS int")
    got = imp.importance_resample(docs, spark.createDataFrame([("a",)], "text string"))
    assert got.columns == ["doc_id", "text", "_row", "_WORDS", "n_features", "weight", "score", "rank"]
    assert sorted(r["rank"] for r in got.collect() if r["rank"]) == [1, 2] and {r["_row"] == r["doc_id"] for r in got.collect()} == {True}


def test_quickselect_finds_every_place(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(6), None if rng.random() < 0.2 else rng.randrange(4), i) for i in range(300)]
    table = spark.createDataFrame(rows, "a long, b long, c long").cache()
    order = sorted(rows, key=lambda r: tuple((v is not None, v) for v in r))
    for k in (1, 2, 150, 299, 300):
        assert imp.quickselect(table, ["a", "b", "c"], k, pivots=3) == order[k - 1]
    assert imp.quickselect(table, ["a", "b", "c"], 301) is None


def test_ranges_are_ranked_in_order(spark):
    rows = spark.range(1000).selectExpr("id * 7919 % 1000 as v")
    got = imp.ranked(rows, ["v"], "place", per_range=90).collect()
    assert {r["v"] + 1 == r["place"] for r in got} == {True} and len(got) == 1000


def test_crc_of_any_bytes():
    rng = np.random.default_rng(0)
    buf = rng.integers(0, 256, 5000).astype(np.uint8)
    starts = rng.integers(0, 4000, 200)
    ends = starts + rng.integers(0, 300, 200)
    got = ~imp.crc_after(buf, starts, ends, np.full(200, 0xFFFFFFFF, np.uint32))
    assert got.tolist() == [zlib.crc32(buf[a:b].tobytes()) for a, b in zip(starts, ends)]
