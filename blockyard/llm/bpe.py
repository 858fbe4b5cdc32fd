"""Byte-level BPE encoding and decoding with a transducer of frequent words.

Spark counts the words of all texts; the frequent ones are merged once and compiled into a minimal acyclic automaton:
words share prefixes and suffixes, and the outputs along a path add up to the word's number, which points to its ids.
The file is mapped into memory by every task. Words outside it are merged exactly, by rank.
"""

from __future__ import annotations

import functools
import heapq
import json
import os
import re
import tempfile
import unicodedata
import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .scratch import small_batches, store

# The public pre-tokenizer's pattern, and the members of its classes below U+0180, where most European text lies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ALL = regex.compile(PATTERN)


def _members(kind: str) -> str:
    return "".join(f"\\u{c:04x}" for c in range(0x180) if regex.match(kind, chr(c)))


_L, _N, _S = _members(r"\p{L}"), _members(r"\p{N}"), _members(r"\s")
_FAST = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_BEYOND = re.compile("[^\x00-ſ]")
MOST_CACHED = 1 << 16


@functools.cache
def _library():
    from tokenizers import pre_tokenizers

    return pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)


def split_words(text: str) -> list[str]:
    """The words that are merged on their own; together they are the text."""
    if not _BEYOND.search(text):
        return _FAST.findall(text)
    if any(unicodedata.category(c) == "Cn" for c in set(text)):  # libraries differ in their Unicode versions
        return [text[a:b] for _, (a, b) in _library().pre_tokenize_str(text)]
    return _ALL.findall(text)


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of every byte in the vocabulary file."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """What a byte-level BPE file says: bytes of each id, merges by rank, and special tokens."""

    pieces: list[bytes]
    merges: dict[tuple[int, int], tuple[int, int]]
    bytes_to_id: list[int]
    special: dict[str, int]

    @staticmethod
    def load(path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = _byte_letters(), spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pieces = [b""] * (1 + max([*vocab.values(), *special.values()]))
        for token, i in vocab.items():
            pieces[i] = bytes(letters[c] for c in token)
        for token, i in special.items():
            pieces[i] = token.encode()
        merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        one = {letters[t]: i for t, i in vocab.items() if len(t) == 1}
        return Vocabulary(pieces, merges, [one.get(b, -1) for b in range(256)], special)

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word: always the pair of lowest rank, leftmost first."""
        ids, merges = [self.bytes_to_id[b] for b in word], self.merges
        if len(ids) > 48:
            return self._merge_long(ids)
        while len(ids) > 1:
            best = min((merges[p][0] if p in merges else 1 << 30 for p in zip(ids, ids[1:])), default=1 << 30)
            if best == 1 << 30:
                break
            out, i, last = [], 0, len(ids) - 1
            while i <= last:
                if i < last and (found := merges.get((ids[i], ids[i + 1]))) and found[0] == best:
                    out.append(found[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap, for words of any length."""
        n, after, before = len(ids), list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(self.merges[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merges]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j], after[i] = self.merges[pair][1], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < n and (p := (ids[x], ids[after[x]])) in self.merges:
                    heapq.heappush(heap, (self.merges[p][0], x, p))
        return [x for x in ids if x >= 0]


    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of single bytes; merges as sorted pair codes with rank and merged id."""
        if not hasattr(self, "_tables"):
            n = len(self.pieces)
            rows = sorted((a * n + b, rank, new) for (a, b), (rank, new) in self.merges.items())
            self._tables = (np.array(self.bytes_to_id, np.int64), *(np.array(c, np.int64) for c in zip(*rows)))
        return self._tables

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """``merge`` for many words side by side, each result as little-endian 32-bit ids."""
        single, keys, ranks, merged = self.tables()
        none, n = len(keys) + 1, len(self.pieces)
        long = {i: np.array(self.merge(w), "<i4").tobytes() for i, w in enumerate(words) if len(w) > 48 or not w}
        lens = np.array([0 if i in long else len(w) for i, w in enumerate(words)], np.int64)
        ids = single[np.frombuffer(b"".join(w for i, w in enumerate(words) if i not in long), np.uint8)]
        word = np.repeat(np.arange(len(words)), lens)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            code = np.empty(len(ids), np.int64)
            code[:-1] = np.where(word[:-1] == word[1:], ids[:-1] * n + ids[1:], -1)
            code[-1] = -1
            at = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
            rank = np.where(keys[at] == code, ranks[at], none)
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            size = np.diff(np.append(first, len(ids)))
            best = np.repeat(np.minimum.reduceat(rank, first), size)
            ended = best == none
            done.append((word[ended], ids[ended]))
            hit = (rank == best) & ~ended
            # In a run of overlapping pairs every second one is merged, from the left.
            edge = np.flatnonzero(hit & ~np.concatenate(([False], hit[:-1])))
            where = np.flatnonzero(hit)
            run = edge[np.searchsorted(edge, where, "right") - 1] if len(where) else where
            where = where[(where - run) % 2 == 0]
            ids[where] = merged[at[where]]
            keep = ~ended
            keep[where + 1] = False
            word, ids = word[keep], ids[keep]
        word, ids = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*done) if done else ((), ())))
        by = np.argsort(word, kind="stable")
        flat, stop = ids[by].astype("<i4").tobytes(), np.cumsum(np.bincount(word, minlength=len(words))) * 4
        return [long.get(i, flat[a:b]) for i, (a, b) in enumerate(zip([0, *stop[:-1].tolist()], stop.tolist()))]


def minimal_automaton(words: list[bytes]) -> tuple[list[list[tuple[int, int]]], list[bool]]:
    """Edges (label, target) and finality of each state of the smallest automaton for sorted, distinct words; the root is last."""
    edges: list[list[tuple[int, int]]] = []
    final: list[bool] = []
    register: dict[tuple, int] = {}
    path: list[list] = [[False, []]]  # states of the last word that may still grow

    def freeze(depth: int) -> None:
        while len(path) > depth:
            done, out = path.pop()
            key = (done, tuple(out))
            if key not in register:
                register[key] = len(edges)
                edges.append(out)
                final.append(done)
            if path:
                label, _ = path[-1][1][-1]
                path[-1][1][-1] = (label, register[key])

    last = b""
    for word in words:
        shared = len(os.path.commonprefix((last, word)))
        freeze(shared + 1)
        for b in word[shared:]:
            path[-1][1].append((b, -1))
            path.append([False, []])
        path[-1][0] = True
        last = word
    freeze(0)
    return edges, final


class Lexicon:
    """The mapped file: edges sorted by (state, byte) with target and output, and the ids of each word."""

    _KINDS = (("keys", "<u4"), ("targets", "<u4"), ("outputs", "<u4"), ("final", "u1"), ("starts", "<u4"), ("ids", "<u4"))

    def __init__(self, path: str):
        head = np.fromfile(path, "<u8", 8)
        self.root, at = int(head[0]), 64
        for (name, kind), n in zip(self._KINDS, head[1:]):
            size = np.dtype(kind).itemsize * int(n)
            setattr(self, name, np.memmap(path, kind, "r", at, (int(n),)) if n else np.zeros(0, kind))
            at += -(-size // 8) * 8

    @classmethod
    def write(cls, path: str, words: list[bytes], ids: list[list[int]]) -> None:
        """``words`` are sorted and distinct; ids[i] belongs to words[i]."""
        edges, final = minimal_automaton(words)
        below = []  # words that can be finished from a state
        for out, done in zip(edges, final):  # targets come before the states that lead to them
            below.append(int(done) + sum(below[t] for _, t in out))
        keys, targets, outputs = [], [], []
        for state, out in enumerate(edges):
            passed = int(final[state])
            for label, target in out:
                keys.append(state << 8 | label), targets.append(target), outputs.append(passed)
                passed += below[target]
        parts = (keys, targets, outputs, final, np.concatenate(([0], np.cumsum([len(x) for x in ids]))), [i for x in ids for i in x])
        with open(path, "wb") as f:
            f.write(np.array([len(edges) - 1, *map(len, parts), 0], "<u8").tobytes())
            for (_, kind), x in zip(cls._KINDS, parts):
                raw = np.asarray(x).astype(kind).tobytes()
                f.write(raw + bytes(-len(raw) % 8))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, or -1; all words walk the automaton side by side."""
        n = len(words)
        out, state, lens = np.zeros(n, np.int64), np.full(n, self.root, np.int64), np.array([len(w) for w in words], np.int64)
        starts, flat = np.concatenate(([0], np.cumsum(lens)))[:n], np.frombuffer(b"".join(words), np.uint8)
        if not len(self.keys):
            return np.full(n, -1)
        going, j = np.arange(n), 0
        while len(going := going[lens[going] > j]):
            key = state[going] << 8 | flat[starts[going] + j]
            at = np.minimum(np.searchsorted(self.keys, key.astype(np.uint32)), len(self.keys) - 1)
            there = self.keys[at] == key
            state[going[~there]] = -1
            going, at = going[there], at[there]
            out[going] += self.outputs[at]
            state[going] = self.targets[at]
            j += 1
        return np.where((state >= 0) & (self.final[state] > 0), out, -1)


@dataclass
class Coder:
    """What tasks need: the vocabulary, and the name of the lexicon file that Spark ships to every executor."""

    vocabulary: Broadcast
    lexicon: str

    def encode(self, docs: DataFrame) -> DataFrame:
        """Adds ids (array<int>); all columns of ``docs`` stay, an older column ids is replaced."""
        docs = docs.drop("ids")
        return docs.mapInArrow(self._encoder(), _schema(docs, "ids array<int>"))

    def decode(self, rows: DataFrame) -> DataFrame:
        """Adds decoded (string), the text of the column ids; all columns stay, an older column decoded is replaced."""
        rows = rows.drop("decoded")
        return rows.mapInArrow(self._decoder(), _schema(rows, "decoded string"))

    def both(self, docs: DataFrame) -> DataFrame:
        """``encode``, then ``decode``, in one pass of the same worker."""
        docs = docs.drop("ids", "decoded")
        encode, decode = self._encoder(), self._decoder()
        return docs.mapInArrow(lambda batches: decode(encode(batches)), _schema(docs, "ids array<int>, decoded string"))

    def _encoder(self):
        coder = self

        def run(batches):
            special = coder.vocabulary.value.special
            cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
            cache = _cache(coder)
            for batch in tn.slices(batches, 1 << 19):
                texts = []
                for text in batch.column("text").to_pylist():
                    parts = cut.split(text or "") if cut and any(s in (text or "") for s in special) else [text or ""]
                    texts.append([w for i, p in enumerate(parts) for w in ([_Special(p)] if i % 2 else split_words(p))])
                cache.fill(set().union(*texts))
                each = [b"".join(map(cache.__getitem__, words)) for words in texts]
                offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in each]))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(each))]))
                yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, "ids"])

        return run

    def _decoder(self):
        coder = self

        def run(batches):
            pieces = coder.vocabulary.value.pieces
            size = np.array([len(p) for p in pieces], np.int64)
            first, flat = np.concatenate(([0], np.cumsum(size)))[:-1], np.frombuffer(b"".join(pieces), np.uint8)
            for batch in batches:
                at = 0
                while at < batch.num_rows:
                    lens = batch.column("ids").slice(at, 256).value_lengths().fill_null(0).to_numpy()
                    n = max(1, int(np.searchsorted(np.cumsum(lens), 1 << 20, "right")))
                    part = batch.slice(at, n)
                    at += part.num_rows
                    ids = part.column("ids").flatten().to_numpy()
                    own = size[ids]
                    stop = np.cumsum(own)
                    raw = flat[np.arange(own.sum()) + np.repeat(first[ids] - (stop - own), own)].tobytes()
                    ends = np.concatenate(([0], stop))[np.cumsum(lens[: part.num_rows])]
                    texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip([0, *ends[:-1]], ends)]
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "decoded"])

        return run


class _Special(str):
    """A special token in a text."""

    __slots__ = ()

    def __hash__(self):
        return hash((str.__hash__(self), 1))

    def __eq__(self, other):
        return isinstance(other, _Special) and str.__eq__(self, other)


class _Cache(dict):
    """Ids of the words met by one worker, as bytes; when full, what is not met again goes."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        super().__init__()
        self.vocabulary, self.lexicon, self.older = vocabulary, lexicon, {}

    def fill(self, words: set[str]) -> None:
        if len(self) > MOST_CACHED:
            self.older = dict(self)
            self.clear()
        new = words - self.keys()
        self.update((w, self.older[w]) for w in new & self.older.keys())
        new = list(new - self.older.keys())
        raw = [w.encode() for w in new]
        unseen = []
        ids, starts = self.lexicon.ids, self.lexicon.starts
        for word, own, number in zip(new, raw, self.lexicon.numbers(raw).tolist()):
            if isinstance(word, _Special):
                self[word] = np.array([self.vocabulary.special[str(word)]], "<i4").tobytes()
            elif number >= 0:
                self[word] = ids[starts[number] : starts[number + 1]].tobytes()
            else:
                unseen.append((word, own))
        self.update(zip([w for w, _ in unseen], self.vocabulary.merge_many([o for _, o in unseen])))


_CACHES: dict[str, _Cache] = {}


def _cache(coder: Coder) -> _Cache:
    if coder.lexicon not in _CACHES:
        _CACHES.clear()
        _CACHES[coder.lexicon] = _Cache(coder.vocabulary.value, Lexicon(SparkFiles.get(coder.lexicon)))
    return _CACHES[coder.lexicon]


def _schema(df: DataFrame, more: str) -> str:
    return ", ".join([f"`{n}` {t}" for n, t in df.dtypes] + [more])


def _frequent(often: DataFrame, most_words: int, slots: int = 1 << 16) -> DataFrame:
    """At most ``most_words`` rows (word, n), of the largest n: whole eighths of a power of two, and of the next one as many by hash as fit.

    Two histograms decide, of at most 512 and ``slots`` rows, so no task ranks words and the driver sees few numbers.
    """
    placed = often.withColumns({"level": F.floor(8 * F.log2("n")), "slot": F.pmod(F.xxhash64("word"), F.lit(slots))})
    told = lambda df, by: [(r[0], r["words"]) for r in df.groupBy(by).agg(F.count("*").alias("words")).collect()]
    room = most_words
    for level, n in sorted(told(placed, "level"), reverse=True):
        if n > room:
            break
        room -= n
    else:
        return often
    upto = 0
    for slot, n in sorted(told(placed.filter(F.col("level") == level), "slot")):
        if n > room:
            break
        room, upto = room - n, slot + 1
    return placed.filter((F.col("level") > level) | ((F.col("level") == level) & (F.col("slot") < upto)))


def build_coder(docs: DataFrame, tokenizer: str, most_words: int = 1 << 17, least_count: int = 4, longest: int = 64) -> Coder:
    """Count the words of all texts and compile the frequent ones.

    The lexicon holds at most ``most_words`` words of at most ``longest`` bytes that occur ``least_count`` times or more;
    this bounds the file, and changes no result, for other words are merged. ``tokenizer`` is the path of a byte-level
    BPE file in the tokenizers format.
    """
    spark, vocabulary = docs.sparkSession, Vocabulary.load(tokenizer)
    small_batches(spark)

    def count(batches):
        held: Counter = Counter()

        def flush():
            kept = [(w, n) for w, n in held.items() if len(w) <= longest]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

        for batch in tn.slices(batches, 1 << 21):
            for text in batch.column("text").to_pylist():
                if text:
                    held.update(split_words(text))
            if len(held) > 300_000:
                yield flush()
        yield flush()

    words = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    often = store(words.filter((F.col("n") >= least_count) & (F.octet_length("word") <= longest)), "words")
    found = sorted(r["word"].encode() for r in _frequent(often, most_words).select("word").collect())
    name = f"lexicon-{uuid.uuid4().hex}"
    path = os.path.join(tempfile.mkdtemp(prefix="spark-lexicon-"), name)
    Lexicon.write(path, found, [np.frombuffer(x, np.int32).tolist() for x in vocabulary.merge_many(found)])
    spark.sparkContext.addFile(path)
    return Coder(spark.sparkContext.broadcast(vocabulary), name)


def encode_decode(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """The columns of ``docs`` with ids (array<int>) and decoded (string).

    Ids are those of the tokenizers library without added special tokens; special tokens written out in a text get
    their own id. A null text is empty: no ids, and an empty decoded text. Repeated rows, null ids and further columns
    pass through; columns named ids or decoded are replaced. An empty table gives an empty result.
    """
    coder = build_coder(docs, tokenizer, **options)
    return coder.both(docs)


def with_digests(coded: DataFrame) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of ``encode_decode``'s rows."""
    return coded.withColumns(
        {
            "n_tokens": F.size("ids").cast("long"),
            "ids_sha256": F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256),
            "decoded_sha256": F.sha2(F.col("decoded"), 256),
        }
    )
