"""Centroid clustering against full scans; bounds must save work and never change a result."""

import hashlib
import math

import numpy as np

from blockyard.llm import centroid_clusters as cc


def plain(rows, k=16, rounds=3, scale=64, dims=64, seed=1):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in kept[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))
    for turn in range(rounds + 1):
        found = [near(v) for _, v in kept]
        if turn < rounds:
            groups = [[v for (_, v), (_, j) in zip(kept, found) if j == own] for own in range(len(cents))]
            cents = [[sum(c) // len(g) for c in zip(*g)] if g else old for g, old in zip(groups, cents)]
    by = [sum(d for d, j in found if j == own) for own in range(len(cents))]
    told = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, j, d, by[j], sum(by), told[j]) for (i, _), (d, j) in zip(kept, found)), key=str)


def run(spark, rows, **options):
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    return sorted((tuple(r)[:6] for r in cc.cluster(vectors, **options).collect()), key=str)


def f32(v):
    return [float(np.float32(x)) for x in v]


def test_against_full_scans(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert run(spark, rows) == plain(rows)


def test_ties_repeats_nulls_and_vectors_that_take_no_part(spark):
    rng = np.random.default_rng(2)
    usual = [(int(i), [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(300)]
    odd = [(None, [1.0, 0.0, 0.0]), (None, [0.0, 1.0, 0.0]), (500, None), (501, []), (502, [1.0, 2.0]), (503, [1.0, None, 0.0]), (504, [float("nan"), 0.0, 0.0]), (505, [float("inf"), 0.0, 0.0]), (506, [3.0, 3.0, 3.0]), (506, [-3.0, 3.0, 3.0]), *([(507, [2.0, 2.0, -2.0])] * 120)]
    rows = usual + odd
    options = {"k": 7, "rounds": 5, "scale": 1, "dims": 3}
    assert run(spark, rows, **options) == plain(rows, **options)
    assert run(spark, rows + [(900, [1e30, 0.0, 0.0])], **options) == plain(rows, **options)


def test_empty_few_and_clashing_names(spark):
    assert run(spark, []) == []
    few = [(i, f32([i / 3] * 64)) for i in range(4)]
    assert run(spark, few) == plain(few)
    vectors = spark.createDataFrame([(i, f32([i / 3] * 64), i, str(i)) for i in range(30)], "vec_id long, embedding array<float>, _x long, _own string")
    got = cc.cluster(vectors, keep=("_x", "_own"))
    assert got.columns == ["vec_id", "_x", "_own", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_measured"]
    assert all(r["_x"] == r["vec_id"] == int(r["_own"]) for r in got.collect())


def test_bounds_hold_and_save_work():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.integers(-40, 41, (200, 8)) + c for c in rng.integers(-400, 400, (12, 8))])
    k, rounds = 20, 12
    history = x[rng.choice(len(x), k, replace=False)][None]
    state = cc.Bounds(x, k)
    for turn in range(rounds):
        state.assign(history)
        d = ((x[:, None] - history[-1][None]) ** 2).sum(2)
        assert (state.own == d.argmin(1)).all()
        far = cc.loosening(history)
        lower = state.lower - far[state.lower_at, np.arange(k)]
        lower[np.arange(len(x)), state.own] = 0
        assert (lower <= np.sqrt(d) + 1e-6).all()
        assert (state.upper + far[state.upper_at, state.own] >= np.sqrt(d[np.arange(len(x)), state.own]) - 1e-6).all()
        centroids = np.array([x[state.own == j].sum(0) // max(1, (state.own == j).sum()) if (state.own == j).any() else history[-1][j] for j in range(k)])
        history = np.concatenate([history, centroids[None]])
    assert state.measured.sum() < 0.4 * len(x) * k * rounds


def test_total_displacement_is_no_more_than_summed_drifts():
    rng = np.random.default_rng(6)
    history = rng.integers(-9, 10, (7, 5, 4))
    far = cc.loosening(history)
    drifts = np.sqrt(((history[1:] - history[:-1]) ** 2).sum(2))
    assert all(far[s, j] <= drifts[s:, j].sum() * (1 + 1e-8) for s in range(7) for j in range(5))
