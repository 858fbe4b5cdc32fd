"""Exact centroid clustering with ns-bounds.

Lloyd's rounds on integer vectors. Every vector keeps an upper bound on the distance to its own centroid and a lower bound
to each other one, and the round in which each was measured; the centroids of all rounds are kept. A bound measured in
round s is loosened in round t by the norm of the centroid's total displacement between s and t, which is never more than
the sum of its drifts from round to round and far less where a centroid moves to and fro. What the bounds cannot rule out
is measured again in whole numbers, so assignments, ties included, are those of a full scan.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import fresh, store

SAFE = 1e-9  # roundings of square roots are far below this share
ROWS = 8192


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to one centroid, or to one each."""
    off = x - c
    return (off * off).sum(1)


def loosening(history: np.ndarray) -> np.ndarray:
    """(rounds, k): how far each centroid has come from where it was in each round, rounded up."""
    off = (history[-1][None] - history).astype(float)
    return np.sqrt((off * off).sum(2)) * (1 + SAFE)


class Bounds:
    """Assignment and bounds of a block of vectors."""

    def __init__(self, x: np.ndarray, k: int):
        n = len(x)
        self.x, self.own, self.upper, self.upper_at = x, np.full(n, -1), np.zeros(n), np.zeros(n, np.int64)
        self.lower, self.lower_at, self.measured = np.zeros((n, k), np.float32), np.zeros((n, k), np.uint16), np.zeros(n, np.int64)

    def _measure(self, rows: np.ndarray, j: np.ndarray | int, centroid: np.ndarray, now: int) -> np.ndarray:
        """Exact distances, which become lower bounds, too."""
        d = squared(self.x[rows], centroid)
        self.lower[rows, j] = np.nextafter((np.sqrt(d.astype(float)) * (1 - SAFE)).astype(np.float32), np.float32(-1))
        self.lower_at[rows, j] = now
        self.measured[rows] += 1
        return d

    def assign(self, history: np.ndarray) -> None:
        """One round: the nearest of the last centroids for every vector, the smaller number on ties."""
        now, centroids, far = len(history) - 1, history[-1], loosening(history)
        k = len(centroids)
        every = np.arange(len(self.x))
        first = self.own < 0
        self.own[first] = 0
        upper = self.upper + far[self.upper_at, self.own]
        lower = self.lower.astype(float) - far[self.lower_at, np.arange(k)]
        lower[every, self.own] = np.inf
        failed = every[first | (lower.min(1) <= upper)]
        if not len(failed):
            return
        best = self._measure(failed, self.own[failed], centroids[self.own[failed]], now)
        upper = np.sqrt(best.astype(float)) * (1 + SAFE)
        doubtful = (lower[failed] <= upper[:, None]) | first[failed, None]
        doubtful[np.arange(len(failed)), self.own[failed]] = False
        choice = self.own[failed]
        for j in range(k):
            at = np.flatnonzero(doubtful[:, j])
            if len(at):
                d = self._measure(failed[at], j, centroids[j], now)
                nearer = (d < best[at]) | ((d == best[at]) & (j < choice[at]))
                best[at[nearer]], choice[at[nearer]] = d[nearer], j
        self.own[failed], self.upper[failed], self.upper_at[failed] = choice, np.sqrt(best.astype(float)) * (1 + SAFE), now


def integers(vector: Column, scale: int, dims: int) -> Column:
    """floor(scale * component) of vectors with ``dims`` finite components of a size that a long's squared distance holds; else null."""
    most = math.isqrt((1 << 61) // dims)
    scaled = F.transform(vector, lambda x: x.cast("double") * scale)
    fine = (F.size(vector) == dims) & F.forall(scaled, lambda x: F.coalesce((x >= -most) & (x < most), F.lit(False)))
    return F.when(fine, F.transform(scaled, lambda x: F.floor(x).cast("int")))


STATE = "_was int, _own int, _upper double, _upper_at int, _lower binary, _lower_at binary, _measured long"


def _round(rows: DataFrame, held: list[str], history: np.ndarray, started: bool) -> DataFrame:
    """The rows' state after one more assignment."""
    told = rows.sparkSession.sparkContext.broadcast(history)
    names = [part.split()[0] for part in STATE.split(", ")]
    types = dict(rows.dtypes)

    def run(batches):
        past = told.value
        k, dims = past.shape[1:]
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                n = batch.num_rows
                state = Bounds(batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(n, dims).astype(np.int64), k)
                if started:
                    take = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
                    state.own, state.upper, state.upper_at, state.measured = take("_own").astype(np.int64), take("_upper").copy(), take("_upper_at").astype(np.int64), take("_measured").copy()
                    state.lower = np.frombuffer(b"".join(batch.column("_lower").to_pylist()), np.float32).reshape(n, k).copy()
                    state.lower_at = np.frombuffer(b"".join(batch.column("_lower_at").to_pylist()), np.uint16).reshape(n, k).copy()
                was = state.own.copy()
                state.assign(past)
                packed = [pa.array([r.tobytes() for r in a], pa.binary()) for a in (state.lower, state.lower_at)]
                flat = [pa.array(was, pa.int32()), pa.array(state.own, pa.int32()), pa.array(state.upper), pa.array(state.upper_at, pa.int32()), *packed, pa.array(state.measured)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in held), *flat], [*held, *names])

    return store(rows.mapInArrow(run, ", ".join([f"`{c}` {types[c]}" for c in held]) + ", " + STATE), "assigned")


def _moves(rows: DataFrame, k: int, dims: int) -> tuple[np.ndarray, list[list[int]]]:
    """What the vectors that changed their cluster add to each cluster's count and sums: whole numbers, added up by Spark."""

    def add(batches):
        n, sums = np.zeros(k, np.int64), [[0] * dims for _ in range(k)]
        for batch in batches:
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims).astype(np.int64)
            for column, sign in (("_own", 1), ("_was", -1)):
                where = batch.column(column).to_numpy(zero_copy_only=False)
                for j in np.unique(where[where >= 0]):
                    mine = where == j
                    n[j] += sign * int(mine.sum())
                    sums[j] = [a + sign * int(b) for a, b in zip(sums[j], x[mine].sum(0))]
        flat = [(j, i, v) for j in range(k) for i, v in enumerate([int(n[j]), *sums[j]]) if v]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in flat], pa.int32()), pa.array([r[1] for r in flat], pa.int32()), pa.array([str(r[2]) for r in flat], pa.string())], ["j", "i", "v"])

    moved = rows.filter("_own <> _was").select("_x", "_own", "_was")
    counts, sums = np.zeros(k, object), [[0] * dims for _ in range(k)]
    for r in moved.mapInArrow(add, "j int, i int, v string").groupBy("j", "i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():
        if r["i"]:
            sums[r["j"]][r["i"] - 1] = int(r["v"])
        else:
            counts[r["j"]] = int(r["v"])
    return counts, sums


def cluster(
    vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dims: int = 64, seed: int = 1,
    id_col: str = "vec_id", column: str = "embedding", keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per vector: its id, ``keep`` columns, cluster, distance, cluster_inertia, inertia, centroid_sha256, n_measured.

    Vectors are floored to whole numbers after scaling; the ``k`` of smallest digest of seed and id (then of smallest
    components) are the first centroids, in that order; ``rounds`` times every vector goes to its nearest centroid and
    centroids become the floored means of theirs (an empty one stays), then all are assigned once more. n_measured counts
    the exact distances to centroids that a vector needed during the rounds. Vectors that are null, of another length, or
    with a null or non-finite component take no part, nor do components of 2^61 / dims or more when squared, whose squared
    distances no long could hold. Repeated rows all count, null ids are written as no characters, fewer vectors than ``k``
    give as many clusters, no vectors no rows; a sum beyond a long is null. The driver holds (rounds + 1) x k x dims
    numbers; each round reads and writes the table once.
    """
    x = "_x"
    taken = vectors.select(F.col(id_col).alias("_id"), integers(F.col(column), scale, dims).alias(x), *(F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep))).filter(F.col(x).isNotNull())
    rows = store(taken, "integers")
    held = rows.columns
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256)
    first = rows.select(digest.alias("digest"), x).orderBy("digest", x).limit(k).collect()
    named = [F.col("_id").alias(id_col), *(F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep))]
    if not first:
        return rows.select(*named, *(F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"), ("n_measured", "long"))))
    k = len(first)
    history = np.array([[r[x] for r in first]], np.int64)
    counts, sums = np.zeros(k, object), [[0] * dims for _ in range(k)]
    for turn in range(rounds + 1):
        rows = _round(rows, held, history, turn > 0)
        if turn == rounds:
            break
        more, added = _moves(rows, k, dims)
        counts = counts + more
        sums = [[a + b for a, b in zip(p, q)] for p, q in zip(sums, added)]
        history = np.concatenate([history, [[[v // int(counts[j]) for v in sums[j]] if counts[j] else history[-1][j].tolist() for j in range(k)]]])
    last = history[-1]
    table = rows.sparkSession.createDataFrame([(j, c.tolist(), ",".join(map(str, c.tolist()))) for j, c in enumerate(last)], "_own int, _c array<bigint>, _told string")
    near = F.aggregate(F.zip_with(x, "_c", lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda s, d: s + d)
    measured = rows.join(F.broadcast(table), "_own").select(*named, F.col("_own").alias("cluster"), near.alias("distance"), F.sha2("_told", 256).alias("centroid_sha256"), F.col("_measured").alias("n_measured"))
    own, number = fresh(measured, "_sum", "_number")
    by = store(measured.groupBy("cluster").agg(F.expr("sum(cast(distance as decimal(38,0)))").alias(own)), "inertia")
    sums_by = by.select(F.col("cluster").alias(number), F.expr(f"try_cast({own} as bigint)").alias("cluster_inertia"), F.expr(f"try_cast(sum({own}) over () as bigint)").alias("inertia"))
    joined = measured.join(F.broadcast(sums_by), F.col("cluster") == F.col(number))
    return joined.select(*(F.col(c) for c in [id_col, *keep]), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_measured")
