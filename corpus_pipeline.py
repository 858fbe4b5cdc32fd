"""The corpus pipeline: quality rules, near duplicates, secrets, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from blockyard.llm.bpe import PATTERN, encode_decode, with_digests
from blockyard.llm.jaccard_join import one_of_each
from blockyard.llm.pfair_mix import by_files, mix, mixed
from blockyard.llm.quality_rules import keep_good
from blockyard.llm.queries import vocabulary
from blockyard.llm.scratch import shared_folder, store
from blockyard.llm.secret_scan import redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of smallest doc_id."""
    return one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark."""
    return redact(docs, vocabulary("byte_bpe_50k.tiktoken"), PATTERN)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come in the order of the mix: file by file, in ranges of its positions."""
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document with its position in the mix, and the digests of the ids and of the text they decode to.

    The position is the document's place in the files that the stage before has written; a table of no files is mixed first.
    """
    few = docs.select("doc_id", "source", "text")
    placed = by_files(few)
    placed = store(mix(few), "places") if placed is None else placed
    coded = with_digests(encode_decode(placed, vocabulary("byte_bpe_50k.json")))
    return coded.select("doc_id", "source", "mix_position", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixing),
    ("BPE encoding and decoding", tokens),
]

#: Sampled paths, a trained language model and a schedule are beyond SQL; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read by the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
