"""Importance resampling towards a target distribution.

Texts become counts over hashed word features. The log ratio of the target's and the corpus' smoothed bucket shares is an
array of gains; a document's weight is the sum of its features' gains, and Gumbel noise from a hash of its id turns the
largest scores into a draw without replacement in proportion to the weights. The k-th largest key is found by quickselect:
random pivot keys cut the rows still in question three ways (below, equal, above), exact counts say which piece holds the
k-th, and only that piece is looked at again. Only the rows drawn are sorted and ranked.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textnum as tn
from .scratch import fresh, store

WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LONG = 64


def _crc_table() -> np.ndarray:
    """Table of the reflected polynomial 0xEDB88320, by its rule."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


CRC = _crc_table()


def crc_after(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, register: np.ndarray) -> np.ndarray:
    """CRC-32 registers after the bytes of each segment; all segments of up to ``LONG`` bytes go byte by byte at once."""
    out, lens = register.copy(), ends - starts
    for i in np.flatnonzero(lens > LONG):
        out[i] = zlib.crc32(buf[starts[i] : ends[i]].tobytes(), int(register[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    short = np.flatnonzero(lens <= LONG)
    short = short[np.argsort(-lens[short], kind="stable")]
    at, left, state = starts[short], lens[short], register[short]
    for j in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -j, "left"))
        state[:n] = CRC[(state[:n] ^ buf[at[:n] + j]) & 0xFF] ^ (state[:n] >> 8)
    out[short] = state
    return out


def word_runs(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word: ASCII letters and digits, and all beyond ASCII."""
    if not len(buf):
        return (np.zeros(0, np.int64),) * 3
    inside = np.concatenate((WORD[buf], [False]))
    begins, stops = inside[:-1].copy(), inside[:-1] & ~inside[1:]
    begins[1:] &= ~inside[:-2]
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(buf))]
    begins[cuts] = inside[cuts]
    stops[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(offs, starts, "right") - 1


def features(column: pa.Array, max_n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of every feature of a text column, and the words of each row; nulls have none."""
    buf, offs = tn.utf8(column)
    low = tn.LOWER[buf]
    starts, ends, rows = word_runs(low, offs)
    register = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    own, found = np.arange(len(starts)), []
    for n in range(max_n):
        if n:
            keep = own + n < len(rows)
            keep[keep] &= rows[own[keep] + n] == rows[own[keep]]
            own, register = own[keep], register[keep]
            register = CRC[(register ^ np.uint32(0x20)) & 0xFF] ^ (register >> 8)
        register = crc_after(low, starts[own + n], ends[own + n], register)
        found.append((rows[own], (~register).astype(np.int64) % buckets))
    row, bucket = (np.concatenate(x) for x in zip(*found))
    return row, bucket, np.bincount(rows, minlength=len(column))


def bucket_counts(docs: DataFrame, text: str, max_n: int, buckets: int) -> np.ndarray:
    """Features of all rows by bucket: each task adds up an array, Spark adds the arrays' cells."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in tn.slices(batches, column=text):
            total += np.bincount(features(batch.column(text), max_n, buckets)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in docs.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of the target's and the corpus' shares, each bucket counted once more."""
    s_all, t_all, b = float(corpus.sum()), float(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + b) / ((s + 1.0) * (t_all + b)))) for s, t in zip(map(float, corpus), map(float, target))], np.int64)


def gumbel(doc_id: Column, seed: int) -> Column:
    """Thousandths of Gumbel noise from the first 32 bits of a digest of seed and id (null: no characters)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def quickselect(rows: DataFrame, key: list[str], k: int, pivots: int = 16) -> tuple | None:
    """The k-th smallest (from 1) of the rows' distinct keys, as a tuple; None if there are fewer.

    Keys are tuples of the columns ``key``, compared from left to right, nulls first. One scan a round: it counts the
    pieces that the pivots make, each pivot's equals apart, and draws the next pivots of every piece at random. The first
    column bounds what later rounds read of the files.
    """
    types = dict(rows.dtypes)
    own = F.struct(*key)
    fixed = lambda values: F.struct(*(F.lit(v).cast(types[c]).alias(c) for c, v in zip(key, values)))
    low = high = None
    cuts: list[tuple] = []
    turn = 0
    while True:
        within = rows
        if low is not None:
            within = within.filter((F.col(key[0]) >= F.lit(low[0])) & (own > fixed(low)))
        if high is not None:
            within = within.filter((F.col(key[0]) <= F.lit(high[0])) & (own < fixed(high)))
        piece = F.lit(0)
        for cut in cuts:
            piece = piece + (own > fixed(cut)).cast("int") + (own >= fixed(cut)).cast("int")
        dealt = within.select(own.alias("own"), piece.alias("piece"), F.xxhash64(*key, F.lit(turn)).alias("h"))
        found = dealt.groupBy("piece", F.pmod("h", F.lit(pivots)).alias("slot")).agg(F.count("*").alias("n"), F.min_by("own", "h").alias("pivot")).collect()
        for i in range(2 * len(cuts) + 1):
            here = [r for r in found if r["piece"] == i]
            n = sum(r["n"] for r in here)
            if k <= n:
                break
            k -= n
        else:
            return None
        if i % 2:
            return cuts[i // 2]
        low, high = (cuts[i // 2 - 1] if i else low), (cuts[i // 2] if i // 2 < len(cuts) else high)
        cuts = sorted((tuple(r["pivot"]) for r in here), key=lambda t: [(v is not None, v) for v in t])
        turn += 1


def ranked(rows: DataFrame, key: list[str], rank: str, per_range: int = 200_000, n: int | None = None) -> DataFrame:
    """``rows`` with their place (from 1) in the order of ``key``: ranges are sorted by themselves, then their sizes added up."""
    part, at, before = fresh(rows, "_part", "_at", "_before")
    many = max(1, -(-(rows.count() if n is None else n) // per_range))
    placed = rows.repartitionByRange(many, *key).sortWithinPartitions(*key).withColumn(at, F.monotonically_increasing_id())
    placed = store(placed.withColumn(part, F.shiftright(at, 33)).withColumn(at, F.col(at).bitwiseAND(F.lit((1 << 33) - 1))), "ranges")
    sizes = placed.groupBy(part).agg(F.count("*").alias("n"))
    sums = sizes.select(part, (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias(before))
    return placed.join(F.broadcast(sums), part).withColumn(rank, F.col(before) + F.col(at) + 1).drop(part, at, before)


def importance_resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, max_n: int = 1, buckets: int = 10_000, seed: int = 2024, min_words: int = 20,
    id_col: str = "doc_id", text: str = "text", target_text: str = "text", with_text: bool = True, pivots: int = 16,
) -> DataFrame:
    """All rows and columns of ``docs`` with n_features, weight, score and rank (long); rank is null where a row isn't drawn.

    floor(percent * N / 100) of the N rows with at least ``min_words`` words are drawn, by score, then the smaller id
    (null ids last), then fewer features; rows equal in all three are interchangeable. Features are runs of 1 to ``max_n``
    words. A null or empty text has no features and weight 0; without any target text the gains favour what is rare in
    ``docs``. Columns of the added names are replaced, others pass through (the text only if ``with_text``). The driver
    holds two arrays of ``buckets`` numbers and a few keys; one range of about 200,000 drawn rows is sorted in a task.
    """
    docs = docs.drop(*(c for c in ("n_features", "weight", "score", "rank") if c != id_col))
    spark = docs.sparkSession
    corpus, aim = bucket_counts(docs, text, max_n, buckets), bucket_counts(target, target_text, max_n, buckets)
    gains = spark.sparkContext.broadcast(bucket_gains(corpus, aim))
    words, row, minus, unnamed = fresh(docs, "_words", "_row", "_minus", "_unnamed")
    held = [n for n in docs.columns if with_text or n != text]

    def weigh(batches):
        for batch in tn.slices(batches, column=text):
            rows, bucket, n_words = features(batch.column(text), max_n, buckets)
            n = np.bincount(rows, minlength=batch.num_rows)
            total = np.zeros(batch.num_rows, np.int64)
            np.add.at(total, rows, gains.value[bucket])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in held), pa.array(n), pa.array(total), pa.array(n_words)], [*held, "n_features", "weight", words])

    types = dict(docs.dtypes)
    schema = ", ".join([f"`{n}` {types[n]}" for n in held] + ["n_features long", "weight long", f"`{words}` long"])
    weighed = docs.mapInArrow(weigh, schema).withColumn("score", F.col("weight") + gumbel(F.col(id_col), seed))
    scored = store(weighed.withColumns({row: F.monotonically_increasing_id(), minus: -F.col("score"), unnamed: F.col(id_col).isNull()}), "scored")
    key = [minus, unnamed, id_col, "n_features", row]
    able = scored.filter(F.col(words) >= min_words)
    k = able.count() * percent // 100
    last = quickselect(able, key, k, pivots) if k > 0 else None
    out = [*held, "n_features", "weight", "score", "rank"]
    if last is None:
        return scored.withColumn("rank", F.lit(None).cast("long")).select(*out)
    kinds = dict(scored.dtypes)
    won = (F.col(words) >= min_words) & (F.struct(*key) <= F.struct(*(F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(key, last))))
    drawn = ranked(scored.filter(won), key, "rank", n=k)
    return drawn.select(*out).union(scored.filter(~won).withColumn("rank", F.lit(None).cast("long")).select(*out))
