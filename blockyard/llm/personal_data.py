"""Personal data: fixed patterns as seeds, and identifiers found by the contexts that seeds teach.

Base spans (email, ip, card, phone) are the first instances. The words next to an instance make three lexical patterns: two
words before it, one word before it, and one word on either side. Spark counts the graph of patterns and instances over all
texts, and how often each pattern occurs with anything at all in its slot; then reliability goes to and fro: a pattern is
worth the reliable share of what fills its slot, an instance what its patterns make likely. Candidates (strings with four
digits, or with an @) in the slot of a pattern of high confidence are spans of kind ``context``.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .scratch import fresh, store

KINDS = ("email", "ip", "card", "phone", "context")
DOMAIN = re.compile(rb"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = np.zeros(256, bool)
LOCAL[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")] = True
IP = re.compile(rb"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(rb"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
#: Candidates: groups of up to 32 digits, or a word of letters, digits and joining signs.
CANDIDATE = re.compile(rb"\(?[0-9](?:[ ().-]{0,2}[0-9]){0,31}+(?![A-Za-z0-9_@\x80-\xff])|[A-Za-z0-9](?:[A-Za-z0-9._%+/:#@-]*[A-Za-z0-9])?+")
DIGIT = re.compile(rb"[0-9]")
NOT_DIGIT = re.compile(rb"[^0-9]")
ALNUM = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
#: Words of contexts: ASCII lower case, every digit as 0.
FOLD = tn.LOWER.copy()
FOLD[0x30:0x3A] = 0x30
#: Fixed multipliers and finishing constants of the three patterns' keys.
TWO_BEFORE, BEFORE, AROUND = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
LINK = np.uint64(0xD6E8FEB86659FD93)


def luhn(digits: bytes) -> bool:
    """The check sum of card numbers."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        d -= 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(kind number, start, end) in bytes, by kind and start; all patterns are ASCII, so bytes do for code points."""
    found, at = [], 0
    buf = np.frombuffer(text, np.uint8)
    while (q := text.find(b"@", at)) >= 0:
        start = q
        while start > at and LOCAL[buf[start - 1]]:
            start -= 1
        m = DOMAIN.match(text, q) if start < q else None
        if m:
            found.append((0, start, m.end()))
        at = m.end() if m else q + 1
    small = lambda part: len(part := part.lstrip(b"0")) < 3 or (len(part) == 3 and part <= b"255")
    found += [(1, *m.span()) for m in IP.finditer(text) if all(map(small, m.groups()))]
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub(b"", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    if b"+" in text:
        found += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m[0])) <= 15]
    return found


def candidates(text: bytes, base: list[tuple[int, int, int]]) -> list[tuple[int, int, bool]]:
    """(start, end, seed): base spans that stand alone, and other strings with four digits or an @ that touch none of them."""
    alone = lambda a, b: (a == 0 or text[a - 1] not in ALNUM) and (b == len(text) or text[b] not in ALNUM)
    out = [(a, b, True) for _, a, b in base if alone(a, b)]
    taken = np.zeros(len(text) + 1, np.int32)
    for _, a, b in base:
        taken[a] += 1
        taken[b] -= 1
    taken = np.cumsum(taken)
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        if (b"@" in m[0] or len(DIGIT.findall(m[0])) >= 4) and alone(a, b) and not taken[a:b].any():
            out.append((a, b, False))
    return sorted(set(out))


def _pair(left: np.ndarray, right: np.ndarray, salt: np.uint64) -> np.ndarray:
    return tn.mix(left * salt + tn.mix(right + LINK))


def slot_keys(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the patterns around every word, as if it filled the slot: two before, one before, one on either side.

    Where a text has no such word, 0 stands for it.
    """
    zero = np.zeros(1, np.uint64)
    n = len(hashes)
    one = np.where(np.concatenate(([False], rows[1:] == rows[:-1])), np.concatenate((zero, hashes[:-1])), 0) if n else hashes
    two = np.where(np.concatenate(([False, False], rows[2:] == rows[:-2]))[:n], np.concatenate((zero, zero, hashes[:-2]))[:n], 0) if n else hashes
    after = np.where(np.concatenate((rows[1:] == rows[:-1], [False])), np.concatenate((hashes[1:], zero)), 0) if n else hashes
    return _pair(two.astype(np.uint64), one.astype(np.uint64), TWO_BEFORE), tn.mix(one.astype(np.uint64) * BEFORE), _pair(one.astype(np.uint64), after.astype(np.uint64), AROUND)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


SPAN = pa.struct([("kind", pa.int8()), ("start", pa.int64()), ("end", pa.int64())])
SEEN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("seed", pa.bool_()), ("what", pa.int64()), ("patterns", pa.list_(pa.int64())), ("told", pa.list_(pa.string()))])


def occurrences(column: pa.Array) -> tuple[list, list]:
    """Base spans and candidates with their patterns of every text of a column; places are code points."""
    buf, offs = tn.utf8(column)
    raw = buf.tobytes()
    folded = FOLD[buf]
    starts, ends, rows, hashes = tn.words(folded, offs)
    starting = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    spans, seen = [], []
    for i in range(len(column)):
        a0, b0 = int(offs[i]), int(offs[i + 1])
        text = raw[a0:b0]
        if b"@" not in text and not DIGIT.search(text):
            spans.append([]), seen.append([])
            continue
        point = lambda at: int(starting[a0 + at] - starting[a0])  # noqa: B023, E731
        base = base_spans(text)
        spans.append([{"kind": k, "start": point(a), "end": point(b)} for k, a, b in base])
        lo, hi = np.searchsorted(starts, (a0, b0))
        own = []
        for a, b, seed in candidates(text, base):
            # Words that the candidate touches fill the slot; its neighbours are the context.
            first = lo + int(np.searchsorted(ends[lo:hi], a0 + a, "right"))
            last = lo + int(np.searchsorted(starts[lo:hi], a0 + b, "left"))
            at = [j if lo <= j < hi else -1 for j in (first - 2, first - 1, last)]
            two, one, after = (hashes[j] if j >= 0 else np.uint64(0) for j in at)
            keys = np.concatenate([_pair(np.array([two]), np.array([one]), TWO_BEFORE), tn.mix(np.array([one]) * BEFORE), _pair(np.array([one]), np.array([after]), AROUND)])
            word = [bytes(folded[starts[j] : ends[j]][:64]).decode("utf-8", "replace") if j >= 0 else "" for j in at]
            what = int.from_bytes(hashlib.blake2b(bytes(text[a:b]), digest_size=8).digest(), "little", signed=True)
            own.append({"start": point(a), "end": point(b), "seed": seed, "what": what, "patterns": _signed(keys).tolist(), "told": [f"{word[0]} {word[1]} _", f"{word[1]} _", f"{word[1]} _ {word[2]}"]})
        seen.append(own)
    return spans, seen


def bitmap(keys: DataFrame, column: str, log_bits: int) -> np.ndarray:
    """Bits of a key column, one each at its last ``log_bits`` bits: of fixed size, whatever the number of keys."""
    at = keys.select(F.col(column).bitwiseAND(F.lit((1 << log_bits) - 1)).alias("at"))
    bits = np.zeros(1 << (log_bits - 3), np.uint8)
    for r in at.groupBy(F.shiftright("at", 5).alias("slot")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 31 as int)))").alias("b")).toLocalIterator():
        bits[r["slot"] * 4 : r["slot"] * 4 + 4] = np.frombuffer(int(r["b"]).to_bytes(4, "little"), np.uint8)
    return bits


def slot_fills(docs: DataFrame, text: str, patterns: DataFrame, log_bits: int = 22) -> DataFrame:
    """(pattern, fills): how often each of the patterns occurs with any word in its slot, over all texts."""
    told = docs.sparkSession.sparkContext.broadcast(bitmap(patterns, "pattern", log_bits))
    mask = np.uint64((1 << log_bits) - 1)

    def count(batches):
        for batch in tn.slices(batches, column=text):
            buf, offs = tn.utf8(batch.column(text))
            _, _, rows, hashes = tn.words(FOLD[buf], offs)
            keys = np.concatenate(slot_keys(hashes, rows))
            low = keys & mask
            keys = keys[(told.value[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            keys, n = np.unique(keys, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(_signed(keys)), pa.array(n.astype(np.int64))], ["pattern", "fills"])

    counted = docs.select(text).mapInArrow(count, "pattern long, fills long").groupBy("pattern").agg(F.sum("fills").alias("fills"))
    return counted.join(patterns.select("pattern"), "pattern")


def learn(seen: DataFrame, docs: DataFrame, text: str, least: int, rounds: int) -> DataFrame:
    """(pattern, told, instances, support, fills, confidence) of all patterns with at least ``least`` different instances.

    ``seen`` has a row per candidate and pattern: pattern, told, what, seed. Rows are counted by (pattern, instance) before
    anything is joined, so copies of a text and patterns seen everywhere cost one row per different instance.
    """
    edges = store(seen.groupBy("pattern", "what").agg(F.count("*").alias("n"), F.max("seed").alias("seed"), F.min("told").alias("told")), "edges")
    known = edges.groupBy("pattern").agg(F.count("*").alias("instances"), F.sum("n").alias("own"), F.min("told").alias("told")).filter(F.col("instances") >= least)
    known = store(known, "patterns")
    # A candidate of several words is no word in a slot between two words, so its occurrences are the least that fills it.
    filled = store(known.join(slot_fills(docs, text, known), "pattern", "left").withColumn("fills", F.greatest("own", F.coalesce("fills", F.lit(0)))), "fills")
    graph = store(edges.join(filled.select("pattern", "fills"), "pattern").select("pattern", "what", "n", "fills"), "graph")
    seeds = edges.groupBy("what").agg(F.max("seed").alias("seed"))
    trust = store(graph.select("what").distinct().join(seeds, "what").select("what", "seed", F.col("seed").cast("double").alias("trust")), "trust")
    for turn in range(rounds):
        weighed = graph.join(trust, "what").groupBy("pattern").agg(F.sum(F.col("n") * F.col("trust")).alias("mass"), F.sum("trust").alias("support"), F.first("fills").alias("fills"))
        worth = store(weighed.withColumn("confidence", F.least(F.col("mass") / (F.col("fills") + 1.0), F.lit(0.999)) * (F.col("support") >= least).cast("double")), "worth")
        if turn == rounds - 1:
            break
        doubt = F.exp(F.sum(F.log(1.0 - F.col("confidence"))))
        back = graph.join(worth.filter("confidence > 0").select("pattern", "confidence"), "pattern").groupBy("what").agg((1.0 - doubt).alias("found"))
        trust = store(trust.join(back, "what", "left").select("what", "seed", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("found", F.lit(0.0))).alias("trust")), "trust")
    return known.join(worth.select("pattern", "support", "fills", "confidence"), "pattern")


def find_personal(docs: DataFrame, text: str = "text", least: int = 3, rounds: int = 3, confident: float = 0.6) -> DataFrame:
    """The columns of ``docs`` with spans, an array of (kind, start, end) in code points, end exclusive, by kind and start.

    A pattern needs ``least`` different instances (by the sum of their reliability) and a confidence of ``confident``,
    which is the reliable share of all that fills its slot. A pattern's word counts whole; digits in it count as 0. A
    null or empty text has no spans. Repeated rows and null ids take part as rows; an older column spans is replaced,
    other columns pass through. Base spans never depend on other rows; spans of kind context do.
    """
    docs = docs.drop("spans")
    base, seen, row, found = fresh(docs, "_base", "_seen", "_row", "_found")
    types = dict(docs.dtypes)

    def scan(batches):
        for batch in tn.slices(batches, column=text):
            spans, own = occurrences(batch.column(text))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, pa.list_(SPAN)), pa.array(own, pa.list_(SEEN))], [*batch.schema.names, base, seen])

    kinds = "array<struct<kind:tinyint,start:bigint,end:bigint>>"
    schema = ", ".join([f"`{n}` {t}" for n, t in types.items()] + [f"`{base}` {kinds}", f"`{seen}` array<struct<start:bigint,end:bigint,seed:boolean,what:bigint,patterns:array<bigint>,told:array<string>>>"])
    scanned = store(docs.mapInArrow(scan, schema).withColumn(row, F.monotonically_increasing_id()), "scanned")
    each = scanned.filter(F.size(seen) > 0).select(F.col(row).alias("row"), F.explode(seen).alias("s"))
    links = each.select("row", "s.*").withColumn("link", F.explode(F.arrays_zip("patterns", "told")))
    links = links.select("row", "start", "end", "seed", "what", F.col("link.patterns").alias("pattern"), F.col("link.told").alias("told"))
    learned = learn(links, scanned, text, least, rounds).filter(F.col("confidence") >= confident)
    hits = links.filter(~F.col("seed")).select("row", "start", "end", "pattern").join(learned.select("pattern"), "pattern")
    more = hits.groupBy(F.col("row").alias(row)).agg(F.collect_set(F.struct(F.lit(len(KINDS) - 1).cast("tinyint").alias("kind"), "start", "end")).alias(found))
    named = F.transform(F.array_sort(F.concat(base, F.coalesce(found, F.array().cast(kinds)))), lambda s: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"].cast("int") + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return scanned.join(more, row, "left").withColumn("spans", named).select(*docs.columns, "spans")


def personal_digests(found: DataFrame) -> DataFrame:
    """Counts by kind, digest of the base spans and all spans as text, for ``find_personal``'s rows."""
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.sha2(told(F.filter("spans", lambda s: s["kind"] != "context")), 256).alias("base_sha256")
    return found.select("doc_id", *(count(k) for k in KINDS), base, told(F.col("spans")).alias("spans"))
