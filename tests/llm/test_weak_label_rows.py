"""The weak-label query against a version that goes text by text."""

import re

import numpy as np
import pyarrow as pa

from blockyard.llm import textnum, weak_labels

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def vote(text):
    words, raw = WORD.findall(text), text.encode()
    n, size = len(words), max(len(raw), 1)
    share = lambda chars: sum(raw.count(c.encode()) for c in chars) / size
    some = max(n, 1)
    low, up = share("abcdefghijklmnopqrstuvwxyz"), share("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    upper, common = up / max(up + low, 1e-9), sum(w in weak_labels.FUNCTION_WORDS for w in words) / some
    kinds, letters = len(set(words)) / some, sum(map(len, words)) / some
    rules = [
        (share("#*$%&<>") < 0.002, share("#*$%&<>") > 0.02), (upper < 0.1, upper > 0.25), (share("!") < 0.001, share("!") > 0.01), (common > 0.15, common < 0.05),
        (n >= 50, n < 20), (kinds > 6 / some**0.5 and n >= 20, kinds < 3 / some**0.5), (share("|") == 0, share("|") > 0.02), (3 < letters < 8, letters > 9 or letters < 2),
    ]
    return [2 if bad else 1 if good else 0 for good, bad in rules]


def posteriors(votes):
    """EM with one posterior per text instead of one per pattern."""
    good = [1 / (1 + np.exp(-float(v.count(1) - 3 * v.count(2)))) for v in votes]
    for _ in range(200):
        prior = min(max(sum(good) / len(good), 0.01), 0.99)
        told = []
        for weight in (good, [1 - g for g in good]):
            table = [[1.0 + sum(w for w, v in zip(weight, votes) if v[k] == x) for x in range(3)] for k in range(8)]
            told.append([[c / sum(row) for c in row] for row in table])
        new = []
        for v in votes:
            a, b = (np.log(p) + sum(np.log(told[c][k][x]) for k, x in enumerate(v)) for c, p in ((0, prior), (1, 1 - prior)))
            new.append(1 / (1 + np.exp(b - a)))
        if max(abs(x - y) for x, y in zip(new, good)) < 1e-9:
            break
        good = new
    return good


def scores(texts, targets, rounds):
    """The logistic scorer on a dense matrix of all texts."""
    buf, offs = textnum.utf8(pa.array(texts))
    row, bucket, weight = weak_labels.features(buf, textnum.words(buf, offs), len(texts))
    x = np.zeros((len(texts), weak_labels.BUCKETS + 1))
    x[row, bucket], x[:, -1] = weight.astype(np.float32), 1
    w, moment, speed = (np.zeros(x.shape[1]) for _ in range(3))
    for step in range(1, rounds + 1):
        g = (1 / (1 + np.exp(-x @ w)) - targets) @ x / len(texts) + 1e-6 * w
        moment, speed = 0.9 * moment + 0.1 * g, 0.99 * speed + 0.01 * g**2
        w = w - 0.3 * (moment / (1 - 0.9**step)) / (np.sqrt(speed / (1 - 0.99**step)) + 1e-5)
    return 1 / (1 + np.exp(-x @ w))


def test_rows_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id < 60").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(1000, None), (1001, ""), (1002, "!!! $$$ BUY | NOW |"), (1002, "!!! $$$ BUY | NOW |")], "doc_id long, text string"))
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()))
    votes = [vote(t) for _, t in rows]
    want = posteriors(votes)
    told = scores([t for _, t in rows], np.array(want), 6)
    got = sorted(weak_labels.quality_classifier(docs, sample=10_000, rounds=6).collect(), key=lambda r: r["doc_id"])
    assert len(got) == len(rows)
    for r, (doc_id, _), v, p, s in zip(got, rows, votes, want, told):
        assert r["doc_id"] == doc_id and r["votes"] == "".join(map(str, v))
        assert abs(r["posterior"] - p) < 1e-6 and abs(r["score"] - s) < 1e-4 and r["kept"] == (r["score"] >= 0.4)
