"""Quality rules: counting rules and a perplexity band per language.

The language model is a modified Kneser-Ney model over byte n-grams. Spark counts the n-grams of every text, the
continuation counts of the lower orders and the mass each context gives away, and joins them order by order to the
probability of every n-gram. None is dropped. The most frequent n-grams, of bounded number, lie as sorted arrays in the
shared folder, which must be one that pyarrow reads from every executor (a file system, HDFS or an object store), and each
task looks most of its texts up in them; what is left, the rare n-grams of each text, meets the rest of the model in one
join, so the model is read once whatever the number of texts. Each language's bands are its median bits per byte plus ``width`` times the
distance of its lower and upper quartile from it, over all texts that pass the counting rules. A text of n characters
is off by its distance times sqrt(n / (n + ``steady``)), for short texts stray further by chance.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .scratch import fresh, shared_folder, small_batches, store

ORDER = 5
BOS, EOS = 2, 3
MIN_WORDS, MAX_REPEAT = 20, 30
MOST_COUNT = 1 << 12
NO_BYTES = int.from_bytes(bytes([BOS] * (ORDER - 1) + [EOS]), "big")
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_counts(buf: np.ndarray, offs: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """The five counts of every row of a batch."""
    starts, ends, rows, hashes = tn.words(buf, offs)
    per_row = lambda at, w=None: np.bincount(at, w, minlength=n).astype(np.int64)
    points = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    out = {"n_words": per_row(rows), "word_chars": per_row(rows, points[ends] - points[starts])}
    out["n_symbols"] = per_row(np.searchsorted(offs, np.flatnonzero(SYMBOLS[buf]), "right") - 1)
    first = np.unique(np.concatenate((offs[:-1], np.flatnonzero(buf == 10) + 1)))
    first = first[first < len(buf)]
    stop = np.append(first[1:], len(buf))
    stop = stop - (buf[stop - 1] == 10) if len(first) else stop[:0]
    told = np.bincount(np.searchsorted(first, starts, "right") - 1, minlength=len(first)) > 0
    first, stop = first[told], stop[told]
    line_row = np.searchsorted(offs, first, "right") - 1
    keys = tn.mix(tn.segment_hash(buf, first, stop) ^ tn.mix(line_row))
    out["n_dup_lines"] = per_row(line_row) - per_row(line_row[np.unique(keys, return_index=True)[1]])
    at, keys = tn.windows(hashes, rows, 8, 8)
    _, inverse, count = np.unique(tn.mix(keys ^ tn.mix(rows[at])), return_inverse=True, return_counts=True)
    at = at[count[inverse] > 1]
    edge = np.zeros(len(hashes) + 8, np.int64)
    edge[at] += 1
    edge[at + 8] -= 1
    out["n_repeat_words"] = per_row(rows[np.cumsum(edge)[: len(rows)] > 0])
    return out


def ngrams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-gram that ends at each byte of a text or at its end, and its row; the last byte is lowest."""
    n, extra = len(offs) - 1, ORDER
    row = np.repeat(np.arange(n), np.diff(offs))
    padded = np.full(len(buf) + extra * n, BOS, np.uint8)
    padded[np.arange(len(buf)) + extra * row + ORDER - 1] = buf
    ends = offs[1:] + extra * np.arange(n) + ORDER - 1
    padded[ends] = EOS
    at = np.sort(np.concatenate((np.arange(len(buf)) + extra * row + ORDER - 1, ends)))
    key = np.zeros(len(at), np.int64)
    for k in range(ORDER):
        key |= padded[at - k].astype(np.int64) << (8 * k)
    return key, np.repeat(np.arange(n), np.diff(offs) + 1)


def _counts(docs: DataFrame) -> DataFrame:
    """(lang, order, key, c): counts of the highest order, distinct left neighbours for the lower ones."""

    def count(batches):
        def rows(lang, parts):
            key, c = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(key, kind="stable")
            key, first = np.unique(key[order], return_index=True)
            return key, np.add.reduceat(c[order], first)

        held: dict[str, list] = {}
        for batch in tn.slices(batches, 1 << 19):
            buf, offs = tn.utf8(batch.column("text"))
            key, row = ngrams(buf, offs)
            codes, names = pd.factorize(np.array(batch.column("lang").to_pylist(), object))
            for i, lang in enumerate(names):
                held.setdefault(lang, []).append(np.unique(key[(codes == i)[row]], return_counts=True))
                if sum(len(p[0]) for p in held[lang]) > 1 << 20:
                    held[lang] = [rows(lang, held[lang])]
                    if len(held[lang][0][0]) > 1 << 19:
                        yield emit(lang, *held.pop(lang)[0])
        for lang, parts in held.items():
            yield emit(lang, *rows(lang, parts))

    def emit(lang, key, c):
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key), pa.array(c.astype(np.int64))], ["lang", "key", "c"])

    texts = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), "text").filter("length(text) > 0")
    top = texts.mapInArrow(count, "lang string, key long, c long").groupBy("lang", "key").agg(F.sum("c").alias("c"))
    top = store(top, f"order{ORDER}")
    out, types = top.withColumn("order", F.lit(ORDER)), top
    for k in range(ORDER - 1, 0, -1):
        types = types.groupBy("lang", F.col("key").bitwiseAND(F.lit((1 << (8 * k)) - 1)).alias("key")).agg(F.count("*").alias("c"))
        out = out.unionByName(types.withColumn("order", F.lit(k)))
    return store(out.select("lang", "order", "key", "c"), "ngrams")


class Model:
    """Sorted arrays: packed n-grams with their probability, packed contexts with the mass they give to lower orders."""

    def __init__(self, langs: list[str], keys: np.ndarray, probs: np.ndarray, contexts: np.ndarray, gammas: np.ndarray):
        self.langs, self.keys, self.probs, self.contexts, self.gammas = {x: i for i, x in enumerate(langs)}, keys, probs, contexts, gammas

    @staticmethod
    def pack(lang, order, key):
        return (np.asarray(lang, np.int64) << 44) | (np.asarray(order, np.int64) << 40) | key

    @staticmethod
    def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def prob(self, lang: np.ndarray, key: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Probability of each n-gram's last byte after the bytes before it."""
        out, todo = np.ones(len(key)), np.arange(len(key))
        for k in range(order, 0, -1):
            own = key[todo] & ((1 << (8 * k)) - 1)
            at, found = self.find(self.keys, self.pack(lang[todo], k, own))
            out[todo[found]] *= self.probs[at[found]]
            todo, own = todo[~found], own[~found]
            at, found = self.find(self.contexts, self.pack(lang[todo], k, own >> 8))
            out[todo[found]] *= self.gammas[at[found]]
        out[todo] /= 256
        return out


def _discounts(counts: DataFrame) -> tuple[list[str], list[tuple]]:
    """The languages, and (lang, order, code of lang, three discounts) of each level."""
    seen = counts.groupBy("lang", "order", F.least("c", F.lit(MOST_COUNT)).alias("c")).agg(F.count("*").alias("n")).toPandas()
    langs = sorted(seen.lang.unique())
    code, levels = {x: i for i, x in enumerate(langs)}, []
    for (lang, order), g in seen.groupby(["lang", "order"]):
        n = {int(c): int(x) for c, x in zip(g.c, g.n)}
        n1, n2, n3, n4 = (n.get(i, 0) for i in (1, 2, 3, 4))
        if min(n1, n2, n3, n4) > 0:
            y = n1 / (n1 + 2 * n2)
            d = [min(max(i - (i + 1) * y * b / a, 0.05), i - 0.05) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        else:
            d = [0.5, 0.75, 0.9]
        levels.append((lang, int(order), code[lang], *d))
    return langs, levels


def _levels(docs: DataFrame) -> tuple[list[str], DataFrame, DataFrame]:
    """The languages, all n-grams (code, order, key, c, p), and all contexts (code, order, key, gamma).

    The suffix of an n-gram that was seen was seen, and so was its context: the probabilities of an order come from those
    of the order below by a join, in which no key has more than 256 rows.
    """
    counts = _counts(docs)
    langs, levels = _discounts(counts)
    table = F.broadcast(docs.sparkSession.createDataFrame(levels, "lang string, order int, code long, d1 double, d2 double, d3 double"))
    off = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    full = counts.join(table, ["lang", "order"]).select("code", "order", "key", "c", off.alias("off"), F.shiftright("key", 8).alias("context"))
    contexts = full.groupBy("code", "order", "context").agg(F.sum("c").alias("total"), F.sum("off").alias("gone"))
    contexts = contexts.select("code", "order", "context", "total", (F.col("gone") / F.col("total")).alias("gamma"))
    alone = ((F.col("c") - F.col("off")) / F.col("total")).alias("alone")
    shares = store(full.join(contexts, ["code", "order", "context"]).select("code", "order", "key", "c", alone, "gamma"), "shares")
    out, lower = None, None
    for k in range(1, ORDER + 1):
        own = shares.filter(F.col("order") == k).withColumn("suffix", F.col("key").bitwiseAND(F.lit((1 << (8 * (k - 1))) - 1)))
        own = own.withColumn("below", F.lit(1 / 256)) if lower is None else own.join(lower, ["code", "suffix"])
        own = own.select("code", "order", "key", "c", (F.col("alone") + F.col("gamma") * F.col("below")).alias("p"))
        own = store(own, f"level{k}")
        lower = own.select("code", F.col("key").alias("suffix"), F.col("p").alias("below"))
        out = own if out is None else out.unionByName(own)
    return langs, out, contexts.select("code", "order", F.col("context").alias("key"), "gamma")


def _collected(langs: list[str], grams: DataFrame, contexts: DataFrame) -> Model:
    def arrays(df: DataFrame, value: str) -> list[np.ndarray]:
        found = df.select("code", "order", "key", value).toArrow()
        code, order, key, values = (found.column(i).to_numpy() for i in range(4))
        keys = Model.pack(code, order, key)
        by = np.argsort(keys)
        return [keys[by], values[by]]

    return Model(langs, *arrays(grams, "p"), *arrays(contexts, "gamma"))


class Lookup:
    """The bits of the n-grams of highest order: the most frequent ones as sorted arrays, all others as a table.

    Every n-gram of a scored text was counted, so its stored probability is all that is looked up.
    """

    def __init__(self, docs: DataFrame, frequent: int):
        langs, grams, contexts = _levels(docs)
        # The n-gram of a text without bytes may be unseen: what it backs off to is a few rows a language.
        empty = [NO_BYTES & ((1 << (8 * k)) - 1) for k in range(1, ORDER + 1)]
        few = _collected(langs, grams.filter(F.col("key").isin(empty)), contexts.filter(F.col("key").isin([x >> 8 for x in empty])))
        told = -np.log2(few.prob(np.arange(len(langs) + 1), np.full(len(langs) + 1, NO_BYTES)))
        self.empty = dict(zip(langs, told.tolist()))
        self.langs = {x: i for i, x in enumerate(langs)}
        packed = F.shiftleft("code", 8 * ORDER) + F.col("key")
        # Counts by eighths of powers of two, from the top down as long as they fit.
        rows = grams.filter(F.col("order") == ORDER).select(packed.alias("key"), (-F.log2("p")).cast("float").alias("bits"), F.floor(8 * F.log2("c")).cast("int").alias("level"))
        levels = sorted(rows.groupBy("level").count().collect(), reverse=True)
        held, least = 0, 1 << 30
        for level, n in levels:
            if held + n > frequent:
                break
            held, least = held + n, level
        self.rest = rows.filter(F.col("level") < least).select("key", "bits") if held < sum(r[1] for r in levels) else None
        self.path = f"{shared_folder(docs.sparkSession)}/frequent-{uuid.uuid4().hex}"
        rows.filter(F.col("level") >= least).select("key", "bits").write.parquet(self.path)


def _arrays(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The frequent n-grams in order, and their bits; read by each task."""
    from pyarrow import fs, parquet

    files, root = fs.FileSystem.from_uri(path)
    held = parquet.read_table(root, columns=["key", "bits"], filesystem=files, use_threads=False)
    key = held.column("key").to_numpy()
    by = np.argsort(key)
    return key[by], held.column("bits").to_numpy()[by]


def _scored(docs: DataFrame, frequent: int) -> DataFrame:
    """doc_id, digest, lang, the five counts and the bits per byte of each row."""
    lookup = Lookup(docs, frequent)
    path, langs, empty = lookup.path, lookup.langs, lookup.empty

    def score(batches):
        keys, bits = _arrays(path)
        for batch in tn.slices(batches, 1 << 19):
            buf, offs = tn.utf8(batch.column("text"))
            counts = base_counts(buf, offs, batch.num_rows)
            key, row = ngrams(buf, offs)
            # A text without bytes is not counted.
            lang = np.array([langs.get(x, 0) for x in batch.column("lang").to_pylist()], np.int64)
            full = np.diff(offs)[row] > 0
            codes, own = pd.factorize((key | (lang[row] << (8 * ORDER)))[full])
            row = row[full]
            at, found = Model.find(keys, own)
            known = np.where(found, bits[at], 0) if len(bits) else np.zeros(len(own))
            told = np.bincount(row, known[codes], minlength=batch.num_rows).astype(float)
            for i in np.flatnonzero(np.diff(offs) == 0).tolist():
                told[i] = empty.get(batch.column("lang")[i].as_py(), 8.0)
            rare = ~found[codes]
            ends = np.cumsum(np.bincount(row[rare], minlength=batch.num_rows))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(own[codes[rare]]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("digest"), batch.column("lang"), *(pa.array(counts[c]) for c in LONGS), pa.array(np.diff(offs) + 1), pa.array(told), lists],
                ["doc_id", "digest", "lang", *LONGS, "size", "told", "rare"],
            )

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("digest"), F.coalesce("lang", F.lit("")).alias("lang"))
    kind = ", ".join(f"{c} long" for c in LONGS)
    scored = rows.mapInArrow(score, f"doc_id long, digest long, lang string, {kind}, size long, told double, rare array<long>")
    scored = store(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    if lookup.rest is None:
        held = F.when(F.size("rare") > 0, F.raise_error(F.lit(CHANGED)).cast("double")).otherwise(F.lit(0.0))
        scored = scored.withColumn("more", held)
    else:
        asked = scored.filter(F.size("rare") > 0).select("row", F.explode("rare").alias("key")).groupBy("row", "key").agg(F.count("*").alias("n"))
        bits = F.coalesce("bits", F.raise_error(F.lit(CHANGED)).cast("float"))
        more = asked.join(lookup.rest, "key", "left").groupBy("row").agg(F.sum(F.col("n") * bits).alias("more"))
        scored = scored.join(more, "row", "left").withColumn("more", F.coalesce("more", F.lit(0.0)))
    bits = F.when(F.col("size") > 1, (F.col("told") + F.col("more")) / F.col("size")).otherwise(F.col("told"))
    return store(scored.select("doc_id", "digest", "lang", *LONGS, bits.alias("bits")), "bits")


CHANGED = "the texts changed between two scans: read them from stored files"


def quality_rules(docs: DataFrame, width: float = 5.0, steady: int = 3000, least_texts: int = 30, frequent: int = 1 << 21) -> DataFrame:
    """One row per input row: doc_id, digest (xxhash64 of the text), lang, the five counts, bits (per byte), base_failed, middle, low, high, kept.

    Null text counts as empty and fails the base rules; null lang is a language of its own. A language with fewer
    than ``least_texts`` texts that pass the base rules has no band. Other columns are ignored; repeated rows each get
    a row and count in the model. ``docs`` is scanned twice and must not change. At most ``frequent`` n-grams, 12 bytes
    each, are held by a task; they change no result.
    """
    small_batches(docs.sparkSession)
    scored = _scored(docs, frequent)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed)
    usable = scored.filter(~F.col("base_failed"))
    middle = usable.groupBy("lang").agg(F.count("*").alias("texts"), F.percentile_approx("bits", 0.5, 10_000).alias("middle"))
    middle = _few(middle.filter(F.col("texts") >= least_texts).select("lang", "middle"))
    size = F.col("word_chars") + F.col("n_words")
    off = (F.col("bits") - F.col("middle")) * F.sqrt(size / (size + steady))
    q = usable.join(middle, "lang").groupBy("lang").agg(F.percentile_approx(off, [0.25, 0.75], 10_000).alias("q"), F.first("middle").alias("middle"))
    bands = _few(q.select("lang", "middle", (width * F.col("q")[0]).alias("low"), (width * F.col("q")[1]).alias("high")))
    inside = F.coalesce(off.between(F.col("low"), F.col("high")), F.lit(True))
    return scored.join(bands, "lang", "left").withColumn("kept", ~F.col("base_failed") & inside)


def _few(bands: DataFrame, most: int = 10_000) -> DataFrame:
    """A table by language, broadcast where it is proven small."""
    held = store(bands, "bands")
    return F.broadcast(held) if held.count() <= most else held


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns as they are."""
    own, digest = fresh(docs, "_id", "_digest")
    gone = quality_rules(docs, **options).filter("not kept").select(F.col("doc_id").alias(own), F.col("digest").alias(digest)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(own)) & F.xxhash64("text").eqNullSafe(F.col(digest))
    return docs.join(gone, same, "left_anti")
