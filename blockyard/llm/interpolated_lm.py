"""Deleted interpolation: n-gram maximum-likelihood estimates mixed by buckets of the context's frequency.

p(w | u) = L2(b) c(uw)/c(u) + L1(b) c(w)/N + L0(b)/(V+1), where b is the bucket of c(u), a power of two. A slice of the
training texts is deleted from the counts; expectation-maximisation learns each bucket's weights on that slice's own
counts, and the score then uses the counts of all training texts.

The model grows with the corpus, so it is never broadcast. Texts are stored and stay in the blocks they are scanned in. Each block
asks for its distinct words and pairs once: their sorted 64-bit hashes go to hash ranges, where equal hashes of all
blocks are added up, and the sums go back to the block. A frequent word thus sends a row's share per block, not one
per occurrence or document.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .scratch import input_bytes, store

END, BEGIN = np.uint64(0xE0D0E0D0E0D0E0D1), np.uint64(0xB0E0B0E0B0E0B0E3)
WORD, PAIR = 0, 1
BUCKETS = 24
SHARES = 2  # blocks of a partition
_FIRST, _SECOND = tn.odd(2, 29)


def tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word and of the end of each text, hash of what comes before it, and its row."""
    buf, offs = tn.utf8(batch.column("text"))
    _, _, rows, hashes = tn.words(buf, offs, lower=True)
    n = batch.num_rows
    count = np.bincount(rows, minlength=n) + 1
    stops = np.cumsum(count) - 1
    token = np.empty(len(rows) + n, np.uint64)
    token[np.arange(len(rows)) + rows] = hashes
    token[stops] = END
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[stops - count + 1] = BEGIN
    return token, before, np.repeat(np.arange(n), count)


def pairs(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return tn.mix(before * _FIRST + token * _SECOND)


def _packed(x: np.ndarray) -> bytes:
    """Small counts in few bytes: the width, then the values."""
    width = 1 if not len(x) or x.max() < 256 else 2 if x.max() < 65536 else 8
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.int64)


def _ranges(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each of ``parts`` equal hash ranges begins in sorted keys."""
    edges = [(i << 64) // parts for i in range(1, parts)]
    return np.concatenate(([0], np.searchsorted(keys, np.array(edges, np.uint64)), [len(keys)]))


def _counted(key: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, and how often fold 0 and fold 1 hold each."""
    keys = np.unique(key)
    out = [keys]
    for f in (0, 1):
        own, n = np.unique(key[fold == f], return_counts=True)
        c = np.zeros(len(keys), np.int32)
        c[np.searchsorted(keys, own)] = n
        out.append(c)
    return tuple(out)


def _added(found: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of equal hashes added up."""
    none = np.zeros(0, np.int64)
    if not found:
        return none.astype(np.uint64), none, none
    key = np.concatenate([x[0] for x in found])
    by = np.argsort(key, kind="stable")
    key = key[by]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else none
    return key[first], *(np.add.reduceat(np.concatenate([x[i] for x in found])[by], first, dtype=np.int64) if len(key) else none for i in (1, 2))


def _places(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and each key's place among them, in 32 bits."""
    by = np.argsort(key)
    key = key[by]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    at = np.empty(len(key), np.int32)
    at[by] = np.cumsum(new, dtype=np.int32) - 1
    return key[new], at


def _requests(docs: DataFrame, parts: int) -> DataFrame:
    """Per block, kind and range: the block's distinct hashes, and how often kept and deleted training texts hold them.

    Rows with use 1 ask again for the hashes of the deleted texts alone; they add nothing.
    """
    names = ["kind", "part", "use", "block", "keys", "kept", "deleted"]

    def ask(batches):
        found: dict[tuple[int, int, int], list] = {}
        for batch in tn.slices(batches):
            token, before, row = tokens(batch)
            every, blocks = batch.column("fold").to_numpy()[row], batch.column("block").to_numpy()[row]
            for kind, every_key in ((WORD, token), (PAIR, pairs(before, token))):
                for block in np.unique(blocks).tolist():
                    key, fold = every_key[blocks == block], every[blocks == block]
                    found.setdefault((block, kind, 0), []).append(_counted(key, fold))
                    own = np.unique(key[fold == 1])
                    found.setdefault((block, kind, 1), []).append((own, np.zeros(len(own), np.int32), np.zeros(len(own), np.int32)))
        for block, kind, use in list(found):
            keys, kept, out = _added(found.pop((block, kind, use)))
            cut = _ranges(keys, parts)
            for p in range(parts):
                a, b = cut[p], cut[p + 1]
                if b > a:
                    blobs = (keys[a:b].tobytes(), _packed(kept[a:b]), _packed(out[a:b]))
                    yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in (kind, p, use, block)), *(pa.array([x], pa.binary()) for x in blobs)], names)

    return docs.mapInArrow(ask, "kind int, part int, use int, block int, keys binary, kept binary, deleted binary")


def _answers(requests: DataFrame) -> DataFrame:
    """Per request: the sums of all blocks; one row of a range also has its share of N and V, of all and of kept texts."""

    def add(table: pa.Table) -> pa.Table:
        use = table.column("use").to_numpy()
        asked = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
        counts = [[_unpacked(x) for x in table.column(c).to_pylist()] for c in ("kept", "deleted")]
        keys, kept, out = _added([x for x, u in zip(zip(asked, *counts), use) if u == 0])
        every = kept + out
        sums = (int(every.sum()), int((every > 0).sum()), int(kept.sum()), int((kept > 0).sum()))
        at = [np.searchsorted(keys, x) for x in asked]
        return pa.table(
            [*(table.column(c) for c in ("kind", "part", "use", "block")), pa.array([_packed((kept if u else every)[i]) for i, u in zip(at, use)], pa.binary())]
            + [pa.array([s] + [0] * (len(use) - 1), pa.int64()) for s in sums],
            ["kind", "part", "use", "block", "counts", "n", "v", "n_kept", "v_kept"],
        )

    return requests.groupBy("kind", "part").applyInArrow(add, "kind int, part int, use int, block int, counts binary, n long, v long, n_kept long, v_kept long")


def _met(docs: DataFrame, answers: DataFrame, each, schema: str) -> DataFrame:
    """Bring every block's texts and answers together: each(texts, rows, c_word, c_context, c_pair) gives a table."""

    def meet(texts: pa.Table, found: pa.Table) -> pa.Table:
        parts: dict[int, list] = {WORD: [], PAIR: []}
        for row in sorted(found.select(["kind", "part", "counts"]).to_pylist(), key=lambda r: r["part"]):
            parts[row["kind"]].append(_unpacked(row["counts"]))
        token, both, begins, rows, base = [], [], [], [], 0
        for batch in tn.slices(iter(texts.to_batches()), 1 << 21):
            t, b, r = tokens(batch)
            token.append(t), both.append(pairs(b, t)), begins.append(b == BEGIN), rows.append((r + base).astype(np.int32))
            base += batch.num_rows
        begins, rows, counts = np.concatenate(begins), np.concatenate(rows), {}
        for kind, held in ((WORD, token), (PAIR, both)):
            key = np.concatenate(held)
            held.clear()
            own, at = _places(key)
            del key
            sums = np.concatenate(parts.pop(kind))
            if len(own) != len(sums):
                raise RuntimeError("a block's texts changed between two scans: read them from stored files")
            counts[kind] = sums.astype(np.uint32 if sums.max() < 1 << 32 else np.int64)[at]
            if kind == WORD:
                # A text begins as often as it ends.
                context = np.empty_like(counts[kind])
                context[1:] = counts[kind][:-1]
                context[begins] = sums[np.searchsorted(own, END)]
        return each(texts, rows, counts[WORD], context, counts[PAIR])

    return docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(meet, schema)


def bucket(count: np.ndarray) -> np.ndarray:
    """The context's frequency as a power of two."""
    return np.minimum(np.log2(count + 1.0).astype(np.int64), BUCKETS - 1)


def learn(events: pd.DataFrame, rounds: int = 60) -> np.ndarray:
    """Weights of pair, word and uniform estimate by bucket, from held-out counts n of (bucket, f2, f1, f0).

    A bucket without counts takes the weights learned over all buckets.
    """

    def fitted(g: pd.DataFrame) -> np.ndarray:
        f, n, w = g[["f2", "f1", "f0"]].to_numpy(float), g["n"].to_numpy(float), np.array([0.4, 0.4, 0.2])
        for _ in range(rounds if len(g) else 0):
            own = f * w
            w = (own / own.sum(1, keepdims=True) * n[:, None]).sum(0) / n.sum()
        w = np.maximum(w, 1e-6)
        return w / w.sum()

    weights = np.tile(fitted(events), (BUCKETS, 1))
    for b, g in events.groupby("bucket"):
        weights[int(b)] = fitted(g)
    return weights


def _events(docs: DataFrame, answers: DataFrame, n: int, v: int) -> pd.DataFrame:
    """Held-out counts by bucket and estimates, the estimates rounded to an eighth of a power of two: a bounded table."""

    def each(texts, rows, word, context, pair):
        log = lambda x: np.where(x > 0, np.round(8 * np.log2(np.maximum(x, 1e-300))), -9999).astype(np.int64)
        q2, q1 = log(pair / np.maximum(context, 1)), log(word / max(n, 1))
        frame = pd.DataFrame({"bucket": bucket(context), "q2": q2, "q1": q1}).value_counts().reset_index(name="n")
        return pa.Table.from_pandas(frame, preserve_index=False)

    kind = "bucket long, q2 long, q1 long, n long"
    met = _met(docs.filter("fold = 1"), answers.filter("use = 1"), each, kind)
    out = met.groupBy("bucket", "q2", "q1").agg(F.sum("n").alias("n")).toPandas()
    for q in "21":
        x = out[f"q{q}"].astype(float)
        out[f"f{q}"] = np.where(x > -9999, 2.0 ** (x / 8), 0.0)
    out["f0"] = 1 / (v + 1)
    return out


def usual_fold(doc_id: str = "doc_id") -> Column:
    """2 (held out) where crc32 of the id's text is divisible by ten, 1 (deleted while weights are learned) for a twentieth of the rest."""
    crc = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    return F.when(crc % 10 == 0, 2).when((crc / 10).cast("long") % 20 == 0, 1).otherwise(0)


def score_texts(docs: DataFrame, fold: Column | None = None, range_bytes: int = 1 << 24) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``fold`` is 2 for texts to keep out of training, 1 for the training slice that is deleted while weights are learned,
    else 0; by default crc32 of the doc_id decides. A null text is empty: its one token is the end. A null doc_id counts
    as the empty string for the fold. Without training texts every estimate is uniform. Repeated rows each count, and
    other columns are ignored. Texts are stored in the shared folder once; a block is a share of a partition of those files.
    """
    parts = max(1, -(-input_bytes(docs) // range_bytes))
    # Stored files split alike in both scans, however the rows of docs come about.
    held = store(docs.select("doc_id", "text", (usual_fold() if fold is None else fold).cast("int").alias("fold")), "texts")
    texts = held.withColumn("block", F.spark_partition_id() * SHARES + F.pmod(F.xxhash64("doc_id", "text"), F.lit(SHARES)).cast("int"))
    answers = store(_answers(_requests(texts, parts)), "answers")
    total = answers.filter(F.col("kind") == WORD).agg(*(F.sum(c).alias(c) for c in ("n", "v", "n_kept", "v_kept"))).first().asDict()
    n, v, n_kept, v_kept = (int(total[c] or 0) for c in ("n", "v", "n_kept", "v_kept"))
    weights = learn(_events(texts, answers, n_kept, v_kept)) if n_kept else np.tile([0.0, 0.0, 1.0], (BUCKETS, 1))

    def each(table, rows, word, context, pair):
        m = table.num_rows
        known, base, score = np.zeros(m, np.int64), np.zeros(m), np.zeros(m)
        for at in range(0, len(rows), 1 << 18):
            own = slice(at, at + (1 << 18))
            r, c, u, cu = rows[own], word[own].astype(float), context[own].astype(float), pair[own].astype(float)
            w = weights[bucket(u)]
            p = w[:, 0] * cu / np.maximum(u, 1) + w[:, 1] * c / max(n, 1) + w[:, 2] / (v + 1)
            np.add.at(known, r, c > 0)
            base += np.bincount(r, np.log10((c + 0.1) / (n + 0.1 * (v + 1))), minlength=m)
            score += np.bincount(r, np.log10(p), minlength=m)
        held = table.column("fold").to_numpy() == 2
        return pa.table(
            [table.column("doc_id"), pa.array(held), pa.array(np.bincount(rows, minlength=m)), pa.array(known), pa.array(np.full(m, n)), pa.array(base), pa.array(score)],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return _met(texts, answers.filter("use = 0"), each, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
