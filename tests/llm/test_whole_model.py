"""The n-gram model keeps every n-gram, whatever their number."""

import math

import numpy as np

from blockyard.llm import quality_rules
from test_operators import kneser_ney


def test_large_models_lose_nothing(spark):
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(33, 123, 4000, np.uint8)).decode() for _ in range(160)]  # over 1.5 million n-grams
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)] + [(-1, "", "en"), (-2, "", "de")], "doc_id long, text string, lang string")
    prob = kneser_ney(texts)
    bits = {r["doc_id"]: r["bits"] for r in quality_rules.quality_rules(df, frequent=100_000).collect()}
    for i in (0, 77, 159):
        b = bytes([2] * 4) + texts[i].encode() + b"\x03"
        assert abs(bits[i] + sum(math.log2(prob(b[j - 4 : j + 1])) for j in range(4, len(b))) / 4001) < 1e-4
    assert abs(bits[-1] + math.log2(prob(b"\x02\x02\x02\x02\x03"))) < 1e-4 and bits[-2] == 8


def test_any_number_of_frequent_grams_gives_the_same_bits(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(None, None, None), (7, "", "en"), (8, "never seen: ¤¤¤", "xx"), (9, "twice", "en"), (9, "twice", "en")], docs.schema)
    df = docs.union(odd)
    told = lambda n: sorted(((r["doc_id"] is None, r["doc_id"], r["digest"], round(r["bits"], 6), r["kept"]) for r in quality_rules.quality_rules(df, frequent=n).collect()), key=str)
    every = told(1 << 21)
    assert len(every) == 65 and told(0) == every and told(500) == every
