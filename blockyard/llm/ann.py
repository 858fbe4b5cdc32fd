"""Nearest neighbours by score-aware anisotropic quantisation.

The smallest distance to x is the largest inner product less half of |x|^2, so inner products are what the codes must
keep. Every vector is cut into pairs of coordinates with 16 centroids each, four bits; codes and centroids minimise a
residual whose part parallel to the vector weighs ``parallel_weight`` times its orthogonal part, for that part is what
changes the products that rank high. A query's table of products is looked up for the packed codes of all vectors, the
best of each batch go to an exact distance on the original vectors, and the exact results of all tasks are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import store

CODES = 16
WIDTH = 2


def parallel_weight(dims: int, share: float = 0.2) -> float:
    """Weight of the parallel residual when products above ``share`` of the norms matter."""
    return max(1.0, (dims - 1) * share**2 / (1 - share**2))


class Codebook:
    """Centroids (subspaces, 16, 2) of vectors padded to an even length."""

    def __init__(self, centroids: np.ndarray, eta: float):
        self.centroids, self.eta = centroids, eta

    @staticmethod
    def split(x: np.ndarray) -> np.ndarray:
        x = np.concatenate([x, np.zeros((len(x), x.shape[1] % WIDTH))], 1)
        return x.reshape(len(x), -1, WIDTH)

    def _pick(self, parts: np.ndarray, m: int, others: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best code of subspace m given the parallel residual of the others, and its own parallel residual."""
        off = parts[:, m, None] - self.centroids[m][None]
        along = (off * parts[:, m, None]).sum(2)
        cost = (off**2).sum(2) + (self.eta - 1) * (others[:, None] + along) ** 2 / norm[:, None]
        code = cost.argmin(1)
        return code, along[np.arange(len(code)), code]

    def encode(self, x: np.ndarray, rounds: int = 3) -> np.ndarray:
        """Codes (rows, subspaces): coordinate descent over subspaces."""
        parts, norm = self.split(x), np.maximum((x**2).sum(1), 1e-300)
        off = parts[:, :, None] - self.centroids[None]
        codes = (off**2).sum(3).argmin(2)
        along = np.take_along_axis((off * parts[:, :, None]).sum(3), codes[:, :, None], 2)[:, :, 0]
        for _ in range(rounds):
            for m in range(parts.shape[1]):
                codes[:, m], along[:, m] = self._pick(parts, m, along.sum(1) - along[:, m], norm)
        return codes

    @classmethod
    def fit(cls, x: np.ndarray, rounds: int = 8, seed: int = 0) -> Codebook:
        """Train on a bounded sample: alternate codes and centroids, each subspace against the residual of the others."""
        parts, norm = cls.split(x), np.maximum((x**2).sum(1), 1e-300)
        rng, n, subs = np.random.default_rng(seed), len(x), parts.shape[1]
        first = np.stack([parts[rng.choice(n, CODES, n < CODES), m] for m in range(subs)])
        book = cls(first, parallel_weight(x.shape[1]))
        for _ in range(rounds):
            codes = book.encode(x, 1)
            along = np.stack([((parts[:, m] - book.centroids[m][codes[:, m]]) * parts[:, m]).sum(1) for m in range(subs)], 1)
            for m in range(subs):
                p, others = parts[:, m], along.sum(1) - along[:, m]
                extra = (book.eta - 1) / norm
                for c in range(CODES):
                    own = codes[:, m] == c
                    if not own.any():
                        book.centroids[m, c] = p[rng.integers(n)]
                        continue
                    q = p[own]
                    left = own.sum() * np.eye(WIDTH) + (q * extra[own, None]).T @ q
                    right = q.sum(0) + (q * (extra[own] * (others[own] + (q**2).sum(1)))[:, None]).sum(0)
                    book.centroids[m, c] = np.linalg.solve(left, right)
                along[:, m] = ((p - book.centroids[m][codes[:, m]]) * p).sum(1)
        return book

    @staticmethod
    def pack(codes: np.ndarray) -> np.ndarray:
        """Two codes to a byte."""
        codes = np.concatenate([codes, np.zeros((len(codes), codes.shape[1] % 2), codes.dtype)], 1).astype(np.uint8)
        return codes[:, 0::2] | codes[:, 1::2] << 4

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(bytes, 256): the product of query q with what each byte of a code stands for."""
        own = np.einsum("mcw,mw->mc", self.centroids, self.split(q[None])[0])
        own = np.concatenate([own, np.zeros((len(own) % 2, CODES))])
        return (own[1::2, :, None] + own[0::2, None, :]).reshape(-1, 256).astype(np.float32)


def _usable(vectors: DataFrame, id_col: str, column: str) -> DataFrame:
    """(vec_id, v): distinct rows with an id and a finite, non-zero vector of the table's usual length."""
    ok = F.expr(f"size({column}) > 0 and forall({column}, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists({column}, x -> x <> 0)")
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(column).isNotNull() & ok).select(F.col(id_col).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (usual["n"] if usual else 0))


def nearest(
    vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding", every: int = 100, k: int = 10,
    reranked: int = 256, sample: int = 20_000, query_block: int = 100_000, query_bytes: int = 1 << 25,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for every row whose id is divisible by ``every``.

    Candidates are all other rows; nearness is the Euclidean distance, ties go to the smaller vec_id. Rows of one id with
    different vectors are queries of their own, each with its own ranks, and candidates of one another. Rows without id,
    null, zero or non-finite vectors and those of an unusual length take no part; a repeated row (same id and vector)
    counts once, and no row is its own query's candidate. Equal vectors share one code and keep their k + 1 smallest
    ids, the most that a query can need. Codebooks are trained on at most ``sample`` vectors, all are indexed. Queries go
    to the tasks in blocks of about ``query_block`` rows and ``query_bytes`` bytes at most that are broadcast one after the other; ``reranked`` vectors of each batch
    of at most 16,384 get exact distances.
    """
    spark, rows = vectors.sparkSession, _usable(vectors, id_col, column)
    by = Window.partitionBy("v").orderBy("vec_id")
    few = rows.distinct().withColumn("at", F.row_number().over(by)).filter(F.col("at") <= k + 1)
    distinct = store(few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "vectors")
    train = np.array([r["v"] for r in distinct.orderBy(F.xxhash64("v")).limit(sample).select("v").collect()], float)
    result = "query long, query_id long, vec_id long, score double"
    if not len(train):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    book = spark.sparkContext.broadcast(Codebook.fit(train))

    def index(batches):
        for batch in batches:
            x = np.array(batch.column("v").to_pylist(), float)
            if len(x):
                codes = Codebook.pack(book.value.encode(x))
                yield pa.RecordBatch.from_arrays([batch.column("ids"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary())], ["ids", "v", "code"])

    indexed = store(distinct.mapInArrow(index, "ids array<long>, v binary, code binary"), "index")
    queries = rows.filter(F.col("vec_id") % every == 0).distinct()
    query_block = max(1, min(query_block, query_bytes // (8 * train.shape[1])))
    queries = store(queries.withColumn("block", F.floor(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) / (1 << 30) * F.lit(max(1, -(-queries.count() // query_block))))), "queries")
    found = None
    for (block,) in queries.select("block").distinct().orderBy("block").collect():
        own = queries.filter(F.col("block") == block).select("vec_id", "v").collect()
        asked = spark.sparkContext.broadcast(([r["vec_id"] for r in own], np.array([r["v"] for r in own], float), block << 32))

        def search(batches, asked=asked):
            ids, q, first = asked.value
            best: list[list[tuple[float, int]]] = [[] for _ in ids]
            for whole in batches:
                for at in range(0, whole.num_rows, 1 << 14):
                    batch = whole.slice(at, 1 << 14)
                    x = np.stack([np.frombuffer(v) for v in batch.column("v").to_pylist()])
                    codes = np.stack([np.frombuffer(c, np.uint8) for c in batch.column("code").to_pylist()], 1)
                    half, names = ((x**2).sum(1) / 2).astype(np.float32), batch.column("ids").to_pylist()
                    for i in range(len(ids)):
                        guess = half.copy()
                        for table, code in zip(book.value.tables(q[i]), codes):
                            guess -= table[code]
                        near = np.argpartition(guess, reranked)[:reranked] if len(guess) > reranked else np.arange(len(guess))
                        exact = np.sqrt(((x[near] - q[i]) ** 2).sum(1))
                        top = np.argsort(exact, kind="stable")[: k + 1]
                        last = exact[top[-1]]
                        new = [(float(exact[j]), v) for j in np.flatnonzero(exact <= last) for v in names[near[j]] if v != ids[i] or (x[near[j]] != q[i]).any()]
                        best[i] = sorted(best[i] + new)[:k]
            flat = [(first + i, ids[i], v, d) for i, b in enumerate(best) for d, v in b]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in flat], t) for c, t in enumerate(kinds)], ["query", "query_id", "vec_id", "score"])

        part = indexed.mapInArrow(search, result)
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = Window.partitionBy("query").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
