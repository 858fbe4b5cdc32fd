"""Token ids in block files, in the order of doc_id.

A block is one row of a Parquet dataset, written and committed by Spark, and can be decoded on its own:

* ``shard``, ``block``: order of the blocks (shards are ranges of doc_id), ``n_ids``
* ``doc_ids``, ``lengths``: the documents in order and the ids of each
* ``ranks``: the block's distinct ids, the most frequent first (ties to the smaller id), little-endian 32-bit
* ``control``: two bits per id, lowest bits first, the bytes of its rank less one
* ``data``: the ranks, little-endian, in one to four bytes each

Frequent ids thus take one byte. Decoding looks the four lengths of each control byte up in a table of 256 rows.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
import uuid
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textnum as tn
from .bpe import _BEYOND, _L, _N, _S, _byte_letters
from .scratch import shared_folder

_FAST = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
_ALL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
MOST_CACHED = 300_000
BLOCK_IDS = 1 << 22
TIE_CHARS = 64
LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)
BLOCKS = "shard int, block int, n_ids long, doc_ids array<long>, lengths array<int>, ranks binary, control binary, data binary"


class WordEncoder:
    """Ids of whole texts by the tokenizers library, which sees each word once per worker."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        whole = json.loads(spec)
        self.special = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in whole["added_tokens"]}
        self.library = Tokenizer.from_str(spec)
        self.model = self.library.model
        self.letters = {b: c for c, b in _byte_letters().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        if not _BEYOND.search(text):  # the normalizer only lowers these letters; white space is dropped anyway
            return _FAST.findall(text.lower())
        text = self.library.normalizer.normalize_str(text)
        if any(unicodedata.category(c) == "Cn" for c in set(text)):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return _ALL.findall(text)

    def ids(self, word: str) -> bytes:
        """One word by the library's model, which takes bytes as letters."""
        return array("I", [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split = []
        for text in texts:
            if self.cut and any(s in text for s in self.special):
                split.append([(p if i % 2 else self.split(p)) for i, p in enumerate(self.cut.split(text))])
            else:
                split.append([self.split(text)])
        if len(self.cache) > MOST_CACHED:
            self.cache, self.older = {}, self.cache
        for word in set().union(*(part for parts in split for part in parts if not isinstance(part, str))) - self.cache.keys():
            self.cache[word] = self.older.get(word) or self.ids(word)
        get = self.cache.__getitem__
        return [b"".join(self.special[part] if isinstance(part, str) else b"".join(map(get, part)) for part in parts) for parts in split]


@functools.lru_cache(1)
def _encoder(spec: str) -> WordEncoder:
    return WordEncoder(spec)


def pack_ids(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranks table, control bytes and data bytes of a block."""
    count = np.bincount(ids)
    table = np.flatnonzero(count)
    table = table[np.argsort(-count[table], kind="stable")].astype("<u4")
    rank_of = np.zeros(len(count), "<u4")
    rank_of[table] = np.arange(len(table), dtype="<u4")
    ranks = rank_of[ids]
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ids) // 4) * 4, np.uint8)
    codes[: len(ids)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return table, control.astype(np.uint8), data


def unpack_ids(n: int, table: np.ndarray, control: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The ids of a block."""
    size = LENGTHS[control].ravel()[:n]
    first = np.cumsum(size, dtype=np.int64) - size
    wide = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.uint32)
    ranks = wide[first] | wide[first + 1] << np.uint32(8)
    if len(table) > 1 << 16:
        ranks |= wide[first + 2] << np.uint32(16) | wide[first + 3] << np.uint32(24)
    return table[ranks & MASKS[size]]


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1, block_ids: int = BLOCK_IDS) -> str:
    """Encode every text, append ``end_id`` and write blocks of about ``block_ids`` ids to ``path``.

    ``tokenizer`` is the path of a file in the tokenizers format. Null text is empty, so its document is ``end_id``
    alone; a null doc_id comes first; equal doc_ids are ordered by text; other columns are ignored. A doc_id of very
    many rows is split by the first ``TIE_CHARS`` characters of their texts; longer texts that are equal so far stay in one task.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches):
        from pyspark import TaskContext

        shard, block, held, total = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            ids = np.frombuffer(b"".join(x for _, x in held), "<u4")
            table, control, data = pack_ids(ids)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()),
                    pa.array([block], pa.int32()),
                    pa.array([len(ids)], pa.int64()),
                    pa.array([[d for d, _ in held]], pa.list_(pa.int64())),
                    pa.array([[len(x) // 4 for _, x in held]], pa.list_(pa.int32())),
                    *(pa.array([x.tobytes()], pa.binary()) for x in (table, control, data)),
                ],
                ["shard", "block", "n_ids", "doc_ids", "lengths", "ranks", "control", "data"],
            )

        for batch in tn.slices(batches, 1 << 22):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), _encoder(spec.value).encode([t or "" for t in batch.column("text").to_pylist()])):
                held.append((doc_id, ids + end))
                total += len(ids) // 4 + 1
                if total >= block_ids:
                    yield flush()
                    block, held, total = block + 1, [], 0
        if held:
            yield flush()

    # Rows of one doc_id are dealt by how their texts begin; copies whose text that is as a whole are dealt at will.
    begins = F.left(F.coalesce("text", F.lit("")), F.lit(TIE_CHARS))
    spread = F.when(F.length(F.coalesce("text", F.lit(""))) < TIE_CHARS, F.rand(1)).otherwise(0.0)
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange("doc_id", begins, spread).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encode, BLOCKS).write.option("compression", "zstd").parquet(path)
    return path


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), n_tokens, and its ids
    (little-endian 32-bit) or, without them, ids_crc32 (unsigned, of those bytes)."""
    blocks = spark.read.schema(BLOCKS).parquet(path)

    def decode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack_ids(row["n_ids"], np.frombuffer(row["ranks"], "<u4"), np.frombuffer(row["control"], np.uint8), np.frombuffer(row["data"], np.uint8)).astype("<u4").tobytes()
                stop = np.cumsum(row["lengths"])
                first = stop - row["lengths"]
                n = len(stop)
                for a in range(0, n, 1024):
                    part = slice(a, a + 1024)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["shard"]] * len(stop[part]), pa.int32()), pa.array([row["block"]] * len(stop[part]), pa.int32()), pa.array(row["doc_ids"][part], pa.int64()), pa.array(first[part]), pa.array(np.array(row["lengths"][part], np.int64)), pa.array([ids[4 * x : 4 * y] for x, y in zip(first[part], stop[part])], pa.binary())],
                        ["shard", "block", "doc_id", "first", "n_tokens", "ids"],
                    )

    sizes = blocks.select("shard", "block", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("own"))
    shards = shards.select("shard", (F.sum("own").over(Window.orderBy("shard")) - F.col("own")).alias("before"))
    inside = (F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_ids")).alias("inside")
    starts = sizes.select("shard", "block", inside).join(shards, "shard").select("shard", "block", (F.col("before") + F.col("inside")).alias("base"))
    rows = blocks.mapInArrow(decode, "shard int, block int, doc_id long, first long, n_tokens long, ids binary")
    what = F.col("ids") if with_ids else F.crc32("ids").alias("ids_crc32")
    rows = rows.select("shard", "block", "doc_id", "first", "n_tokens", what).join(starts, ["shard", "block"])
    return rows.select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids" if with_ids else "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write the files to the shared folder and read them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = write_tokens(docs, tokenizer, f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}", **options)
    return read_tokens(spark, path, with_ids=False)
