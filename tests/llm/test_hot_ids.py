import zlib

import numpy as np

from blockyard.llm import queries, token_files


def test_null_ids_spread_over_tasks_in_order(spark, tmp_path):
    from tokenizers import Tokenizer

    vocabulary = queries.vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(vocabulary)
    library.no_truncation(), library.no_padding()
    rows = [(None, f"text {i % 97} of nobody") for i in range(600)] + [(i, f"text {i}") for i in range(300)] + [(7, "x" * 300 + str(i)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or one task would hold this little table
    try:
        path = token_files.write_tokens(docs, vocabulary, str(tmp_path / "tokens"), block_ids=500)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    shards = spark.read.parquet(path).selectExpr("shard", "explode(doc_ids) as doc_id").filter("doc_id is null").select("shard").distinct().count()
    assert shards > 1
    want, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_files.read_tokens(spark, path, with_ids=False).collect()), key=lambda r: r[1]) == want
