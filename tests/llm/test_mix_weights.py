"""The mix follows the exact weights of any number of sources."""

from collections import defaultdict

import numpy as np
import pytest

from blockyard.llm import pfair_mix


@pytest.mark.parametrize("small", [3, 600, 1500])
def test_exact_weights(small):
    weights = {"big": 0.5} | {f"s{i}": 0.5 / small for i in range(small)}
    blocks = {"big": 1000} | dict.fromkeys(list(weights)[1:], -(-1000 // small))
    names, who, number, slots = pfair_mix.schedule(blocks, weights)
    assert sorted(slots.tolist()) == list(range(len(slots)))
    big = np.sort(slots[who == names.index("big")])
    for t in range(1, 2001):
        assert abs(np.searchsorted(big, t) - t / 2) < 1


def test_ends_and_odd_weights():
    rng = np.random.default_rng(3)
    for _ in range(20):
        blocks = {str(i): int(rng.integers(1, 60)) for i in range(12)}
        weights = {s: float(rng.random() ** 4 + 1e-6) for s in blocks}
        names, who, number, slots = pfair_mix.schedule(blocks, weights)
        release, deadline = pfair_mix.windows(np.array([blocks[s] for s in names]), np.array([weights[s] for s in names]))
        assert sorted(slots.tolist()) == list(range(len(slots)))
        assert (release <= slots).all() and (slots < deadline).all()
        by = defaultdict(list)
        for w, n, s in zip(who, number, slots):
            by[w].append((n, s))
        assert all([s for _, s in sorted(x)] == sorted(s for _, s in x) for x in by.values())


def test_many_sources(spark):
    df = spark.range(20_000).selectExpr("id as doc_id", "cast(id % 10001 as string) as source")
    assert pfair_mix.mix(df).select("mix_position").distinct().count() == 20_000
