"""Large groups of near copies: classes and links are exact, by a brute-force product of all sets."""

from collections import Counter

import numpy as np
import pytest

from blockyard.llm import jaccard_join
from test_operators import classes


def brute(texts):
    """Class and links of each text, distinct texts of five words or more, by one matrix product."""
    words = [t.split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in words]
    code = {s: i for i, s in enumerate(sorted(set().union(*sets)))}
    often = Counter(s for own in sets for s in own)
    code = {s: i for i, s in enumerate(s for s in code if often[s] > 1)}
    m = np.zeros((len(texts), len(code)), np.float32)
    for i, own in enumerate(sets):
        m[i, [code[s] for s in own if s in code]] = 1
    n = np.array([len(s) for s in sets])
    linked = 9 * (m @ m.T).round() >= 4 * (n[:, None] + n[None])
    np.fill_diagonal(linked, False)
    low = np.arange(len(texts))
    while True:
        new = np.array([min(low[i], low[row].min()) if row.any() else low[i] for i, row in enumerate(linked)])
        if (new == low).all():
            return low, linked.sum(1)
        low = new


def near_copies(n, seed, changes):
    rng = np.random.default_rng(seed)
    base = [f"word{i}" for i in range(120)]
    out = []
    for i in range(n):
        own = list(base)
        for k in rng.choice(120, rng.integers(*changes), replace=False).tolist():
            own[k] = f"own{rng.integers(5)}x{k}" if rng.random() < 0.5 else f"only{i}x{k}"
        out.append(" ".join(own))
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("changes", [(0, 3), (1, 9)])
def test_five_thousand_near_copies(spark, changes):
    texts = near_copies(5000, 1, changes)
    low, links = brute(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.jaccard_join(df).collect()}
    assert got == {i: (int(a), int(b)) for i, (a, b) in enumerate(zip(low, links))}


def test_copies_and_loose_groups(spark):
    texts = near_copies(150, 2, (0, 12))
    rows = [(i, t) for i, t in enumerate(texts * 2)] + [(None, texts[0]), (900, " ".join(f"w{i}" for i in range(90)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.jaccard_join(df, small=8, tile=16, block=16).collect())
    assert got == classes(rows)


def test_broadcast_or_not(spark):
    rows = list(enumerate(near_copies(60, 3, (0, 6))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    wide, narrow = (sorted(map(tuple, jaccard_join.jaccard_join(df, most_broadcast=n).collect())) for n in (0, 1000))
    assert wide == narrow and Counter(r[:3] for r in wide) == classes(rows)
