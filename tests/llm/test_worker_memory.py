"""What a Python worker holds at once is bounded by bytes, not by rows."""

import pyarrow as pa
from pyspark.sql import functions as F

from blockyard.llm import bpe
from blockyard.llm.quality_rules import quality_rules


def test_the_cache_of_words_stays_small():
    class Plain:
        ids, starts = None, None

        def numbers(self, words):
            return bpe.np.full(len(words), -1)

        def merge_many(self, words):
            return [b"abcd"] * len(words)

    cache = bpe._Cache(Plain(), Plain())
    for i in range(0, 400_000, 20_000):
        words = {f"w{k}" for k in range(i, i + 20_000)}
        cache.fill(words)
        assert words <= cache.keys()
        assert len(cache) + len(cache.older) <= 200_000


def test_batches_are_bounded_by_bytes(spark):
    """500 texts of 100 KB come in several batches once an operator on texts was planned."""
    docs = spark.range(0, 500, 1, 1).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.concat(F.col("id").cast("string"), F.repeat(F.lit(" abc defg"), 11_000)).alias("text"))
    quality_rules(docs.filter("doc_id < 40"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["bytes"])

    found = [r["bytes"] for r in docs.mapInArrow(sizes, "bytes long").collect()]
    assert max(found) < 8 << 20 and sum(found) > 49_000_000
