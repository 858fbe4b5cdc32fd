"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every text. Expectation-maximisation over the counts of all vote
patterns estimates how each labeller votes on good and on bad texts (its accuracy, also of its silence) and gives each
pattern a posterior. A hashed linear scorer then learns the posteriors from features that the labellers don't see,
words and word shapes, on a bounded sample, and scores every text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .scratch import store

LABELLERS = ("symbols", "capitals", "shouting", "function_words", "length", "variety", "lists", "word_length")
# Frequent function words of four languages.
FUNCTION_WORDS = (
    "the of and to in a is that it for on with as was be by at from this are or an "
    "de la le et les des en un une du que qui dans pour par sur est pas au avec "
    "der die und den von zu das mit sich auf ist im dem nicht ein eine es "
    "el los las por con para una su al lo como se y"
).split()
BUCKETS = 1 << 15
GOOD, BAD, SILENT = 1, 2, 0


def _mask(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_SYMBOL, _SHOUT, _PIPE = _mask("#*$%&<>"), _mask("!"), _mask("|")
_UPPER, _LOWER = _mask("".join(map(chr, range(65, 91)))), _mask("".join(map(chr, range(97, 123))))
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[_UPPER], _SHAPE[_LOWER | (np.arange(256) >= 128)], _SHAPE[48:58] = 65, 97, 48


def _function_hashes() -> np.ndarray:
    buf, offs = tn.utf8(pa.array(FUNCTION_WORDS))
    return np.unique(tn.words(buf, offs)[3])


def votes(buf: np.ndarray, offs: np.ndarray, words: tuple) -> np.ndarray:
    """(rows, labellers): what each labeller says of each row."""
    starts, ends, rows, hashes = words
    n, size = len(offs) - 1, np.maximum(np.diff(offs), 1)

    def share(mask):
        total = np.concatenate(([0], np.cumsum(mask[buf])))
        return (total[offs[1:]] - total[offs[:-1]]) / size

    count = np.bincount(rows, minlength=n)
    some = np.maximum(count, 1)
    common = np.bincount(rows, np.isin(hashes, _function_hashes()), minlength=n) / some
    kinds = np.bincount(rows[np.unique(tn.mix(hashes ^ tn.mix(rows)), return_index=True)[1]], minlength=n) / some
    points = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    letters = np.bincount(rows, points[ends] - points[starts], minlength=n) / some
    upper = share(_UPPER) / np.maximum(share(_UPPER) + share(_LOWER), 1e-9)

    def vote(good, bad):
        return np.where(bad, BAD, np.where(good, GOOD, SILENT))

    out = [
        vote(share(_SYMBOL) < 0.002, share(_SYMBOL) > 0.02),
        vote(upper < 0.1, upper > 0.25),
        vote(share(_SHOUT) < 0.001, share(_SHOUT) > 0.01),
        vote(common > 0.15, common < 0.05),
        vote(count >= 50, count < 20),
        vote((kinds > 6 / np.sqrt(some)) & (count >= 20), kinds < 3 / np.sqrt(some)),
        vote(share(_PIPE) == 0, share(_PIPE) > 0.02),
        vote((letters > 3) & (letters < 8), (letters > 9) | (letters < 2)),
    ]
    return np.stack(out, 1).astype(np.int64)


def features(buf: np.ndarray, words: tuple, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and weight of hashed words and shapes of word ends; each row's weights have length one."""
    starts, ends, rows, hashes = words
    shape = _SHAPE[buf]
    tail = np.zeros(len(starts), np.uint64)
    for k in range(1, 4):
        at = np.maximum(ends - k, starts)
        tail = tail * np.uint64(257) + shape[at] + np.uint64(1)
    tail = tail * np.uint64(257) + shape[starts] if len(starts) else tail
    bucket = np.concatenate((hashes % np.uint64(BUCKETS // 2), tn.mix(tail) % np.uint64(BUCKETS // 2) + np.uint64(BUCKETS // 2))).astype(np.int64)
    key, c = np.unique(np.concatenate((rows, rows)) * BUCKETS + bucket, return_counts=True)
    row, bucket, weight = key // BUCKETS, key % BUCKETS, np.log1p(c)
    return row, bucket, weight / np.sqrt(np.bincount(row, weight**2, minlength=n))[row]


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each vote pattern, P(vote | class, labeller), and the share of good texts."""
    m = patterns.shape[1]
    lead = (patterns == GOOD).sum(1) - 3 * (patterns == BAD).sum(1)
    good = 1 / (1 + np.exp(-lead.astype(float)))
    told = np.full((2, m, 3), 1 / 3)
    prior = 0.5
    for _ in range(rounds):
        prior = float(np.clip((good * counts).sum() / counts.sum(), 0.01, 0.99))
        for c, weight in enumerate((good * counts, (1 - good) * counts)):
            for v in (SILENT, GOOD, BAD):
                told[c, :, v] = ((patterns == v) * weight[:, None]).sum(0) + 1
        told /= told.sum(2, keepdims=True)
        logs = [np.log(told[c][np.arange(m), patterns]).sum(1) for c in (0, 1)]
        new = 1 / (1 + np.exp(np.clip(logs[1] - logs[0] + np.log((1 - prior) / prior), -500, 500)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return good, told, prior


def _scan(docs: DataFrame, each, schema: str) -> DataFrame:
    def run(batches):
        for batch in tn.slices(batches, 1 << 22):
            buf, offs = tn.utf8(batch.column("text"))
            yield each(batch, buf, offs, tn.words(buf, offs))

    return docs.mapInArrow(run, schema)


def _train(sample: DataFrame, posterior: dict[int, float], rounds: int) -> np.ndarray:
    """Logistic regression on posteriors by full gradients, each summed over the partitions of the sample."""
    spark = sample.sparkSession
    table = spark.sparkContext.broadcast(posterior)

    def pack(batch, buf, offs, words):
        row, bucket, weight = features(buf, words, batch.num_rows)
        target = np.array([table.value[p] for p in batch.column("pattern").to_pylist()])
        copies = batch.column("copies").to_numpy(zero_copy_only=False).astype(float)
        blobs = (row.astype(np.int32), bucket.astype(np.int32), weight.astype(np.float32), target, copies)
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in blobs], ["row", "bucket", "weight", "target", "copies"])

    rows = store(_scan(sample, pack, "row binary, bucket binary, weight binary, target binary, copies binary"), "features")
    w, moment, speed = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for step in range(1, rounds + 1):
        weights = spark.sparkContext.broadcast(w)

        def gradient(batches, weights=weights):
            w, g, n = weights.value, np.zeros(BUCKETS + 1), 0
            for batch in batches:
                for r in batch.to_pylist():
                    row, bucket, weight, target, copies = (np.frombuffer(r[c], k) for c, k in (("row", np.int32), ("bucket", np.int32), ("weight", np.float32), ("target", float), ("copies", float)))
                    out = np.bincount(row, w[bucket] * weight, minlength=len(target)) + w[-1]
                    off = (1 / (1 + np.exp(-np.clip(out, -50, 50))) - target) * copies
                    g[:-1] += np.bincount(bucket, off[row] * weight, minlength=BUCKETS)
                    g[-1] += off.sum()
                    n += int(copies.sum())
            yield pa.RecordBatch.from_arrays([pa.array([g.tobytes()], pa.binary()), pa.array([n], pa.int64())], ["g", "n"])

        parts = rows.mapInArrow(gradient, "g binary, n long").collect()
        total = sum(np.frombuffer(p["g"]) for p in parts) / max(1, sum(p["n"] for p in parts)) + 1e-6 * w
        moment, speed = 0.9 * moment + 0.1 * total, 0.99 * speed + 0.01 * total**2
        w = w - 0.3 * (moment / (1 - 0.9**step)) / (np.sqrt(speed / (1 - 0.99**step)) + 1e-5)
        weights.unpersist()
    return w


def quality_classifier(docs: DataFrame, sample: int = 20_000, rounds: int = 25, threshold: float = 0.4) -> DataFrame:
    """One row per input row: doc_id, votes (one digit per labeller: 0 silent, 1 good, 2 bad), posterior, score, kept.

    The scorer is fitted on about ``sample`` different rows at most, those of small hash, whose labels are posteriors; a
    repeated row is one of them and weighs as much as its copies. Counts of patterns cover all rows, and all are scored. Null text is empty. Null and repeated ids, repeated rows and ties are rows like
    others; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    powers = 3 ** np.arange(len(LABELLERS))

    def vote(batch, buf, offs, words):
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(votes(buf, offs, words) @ powers)], ["doc_id", "text", "pattern"])

    texts = docs.select("doc_id", "text")
    voted = _scan(texts, vote, "doc_id long, text string, pattern long")
    counts = voted.groupBy("pattern").agg(F.count("*").alias("n")).toPandas().sort_values("pattern")
    if not len(counts):
        return spark.createDataFrame([], "doc_id long, votes string, posterior double, score double, kept boolean")
    codes = counts.pattern.to_numpy()
    good, _, _ = estimate(codes[:, None] // powers % 3, counts.n.to_numpy(float))
    posterior = dict(zip(codes.tolist(), good.tolist()))
    share = min(1.0, sample / float(counts.n.sum()))
    chosen = texts.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1))

    def vote_once(batch, buf, offs, words):
        return pa.RecordBatch.from_arrays([batch.column("text"), batch.column("copies"), pa.array(votes(buf, offs, words) @ powers)], ["text", "copies", "pattern"])

    distinct = chosen.groupBy("doc_id", "text").agg(F.count("*").alias("copies")).repartition(8)
    w = spark.sparkContext.broadcast(_train(_scan(distinct.select("text", "copies"), vote_once, "text string, copies long, pattern long"), posterior, rounds))
    table = spark.sparkContext.broadcast(posterior)

    def score(batch, buf, offs, words):
        code = votes(buf, offs, words) @ powers
        row, bucket, weight = features(buf, words, batch.num_rows)
        out = np.bincount(row, w.value[bucket] * weight, minlength=batch.num_rows) + w.value[-1]
        told = ["".join(map(str, r)) for r in (code[:, None] // powers % 3).tolist()]
        own = [table.value[c] for c in code.tolist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(told, pa.string()), pa.array(own, pa.float64()), pa.array(1 / (1 + np.exp(-np.clip(out, -50, 50))))], ["doc_id", "votes", "posterior", "score"])

    return _scan(texts, score, "doc_id long, votes string, posterior double, score double").withColumn("kept", F.col("score") >= threshold)
