"""Every operator against a brute-force version, and on awkward tables."""

import hashlib
import json
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockyard.llm import ann, bpe, chat_rotation, interpolated_lm, jaccard_join, pfair_mix, quality_rules, queries, secret_scan, token_files, weak_labels

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, fold int"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ODD = [
    (1, None, None, None, None, "x", 1),
    (2, "", "en", "", 0, None, None),
    (3, " \n\t ", "en", "a", 3, "", 0),
    (None, "one two three four five six seven", "en", "a", 33, "n", 0),
    (5, "one two three four five six seven", "en", "a", 33, "n", 0),
    (5, "one two three four five six seven", "en", "a", 33, "n", 0),
    (6, "hi there", "de", "b", 8, "n", 0),
    (7, "hi there", "de", "b", 8, "n", 0),
    (8, LONG, "en", "a", len(LONG), "n", 0),
    (9, "日本語テキスト😀 naïve <|endoftext|> x<|startoftext|> it's 'S ʼn İΣς " + "z" * 300, "ja", "c", 9, "n", 0),
]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def classes(rows):
    """Rows (id, text) to class and links of each row by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * len(sets[i] | sets[j]):
                links[i], links[j] = links[i] + 1, links[j] + 1
                parent[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(rows[i][0])
    low = {r: min((x for x in m if x is not None), default=None) for r, m in members.items()}
    return Counter((rows[i][0], low[find(i)], links[i]) for i in range(len(rows)))


def test_jaccard_join(docs, odd, none):
    for df in (docs, odd, none):
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.jaccard_join(df).collect())
        assert got == classes(rows)


def test_jaccard_join_splits_and_tiles(spark):
    base = [f"word{i}" for i in range(60)]
    rows = [(i, " ".join(base[:40] + [f"own{i}"] * 1 + base[41:])) for i in range(120)] + [(1000 + i, " ".join(base[:20] + [f"u{i}x{k}" for k in range(60)])) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.jaccard_join(df, small=16, tile=32).collect())
    assert got == classes(rows)


def test_one_of_each(spark):
    df = spark.createDataFrame([(3, "a b c d e f"), (1, "a b c d e f"), (2, "x y z x y z"), (4, None)], "doc_id long, text string")
    assert {r["doc_id"] for r in jaccard_join.one_of_each(df).collect()} == {1, 2, 4}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_bpe(docs, odd, none, name):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary(name))
    library.no_truncation(), library.no_padding()
    for df in (docs, odd, none):
        for r in bpe.with_digests(bpe.encode_decode(df, queries.vocabulary(name), least_count=2)).collect():
            ids = library.encode(r["text"] or "", add_special_tokens=False).ids
            assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)
            assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r["n_tokens"] == len(ids)


def test_automaton_is_minimal_and_exact(tmp_path):
    words = sorted({b"tap", b"taps", b"top", b"tops", b"stop", b"stops", b""} - {b""})
    edges, final = bpe.minimal_automaton(words)
    assert len(edges) == 7  # root, s, st, t, then one state each after the vowel, after p, and at the end
    bpe.Lexicon.write(str(tmp_path / "x"), words, [[i, i + 1] for i in range(len(words))])
    lexicon = bpe.Lexicon(str(tmp_path / "x"))
    assert lexicon.numbers(words + [b"to", b"tapss", b"q", b""]).tolist() == [*range(len(words)), -1, -1, -1, -1]


def test_token_files(docs, odd, none, tmp_path):
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation(), library.no_padding()
    for df in (docs, odd, none):
        rows = sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        want, start = Counter(), 0
        for doc_id, text in rows:
            ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
            want[doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
            start += len(ids)
        got = token_files.round_trip(df, path, block_ids=5000).collect()
        assert Counter((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == want


def test_id_coding():
    rng = np.random.default_rng(0)
    for ids in (np.array([7]), rng.integers(0, 3, 10), rng.integers(0, 200_000, 150_001), rng.integers(0, 1 << 20, 90_000)):
        assert (token_files.unpack_ids(len(ids), *token_files.pack_ids(ids)) == ids).all()


def test_secret_scan(docs, odd, none):
    ranks = queries.vocabulary("byte_bpe_50k.tiktoken")
    for df in (docs, odd, none):
        for r in secret_scan.find_secrets(df, ranks, bpe.PATTERN).withColumn("r", F.lit(0)).collect():
            t = r["text"] or ""
            base = [(m.start(), 0, m.end()) for m in secret_scan.ASSIGN.finditer(t) if len(m[2]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
            assert [(s["start"], secret_scan.KINDS.index(s["kind"]), s["end"]) for s in r["spans"] if s["kind"] != "random"] == sorted(base)


def test_secret_kinds(spark):
    text = "é apiKey='aZ9dkq82JkQpLm2x' xoxb9A8f7Kq2Lp0ZtY3wVbN4mR6s 550e8400-e29b-41d4-a716-446655440000 4785380592391139 https://a.b/q9A8f7Kq2Lp0ZtY3wVbN4mR6s release_notes_2024_final_version Donaudampfschifffahrtsgesellschaft"
    df = spark.createDataFrame([(1, text, 5)], "doc_id long, text string, n_chars long")
    args = (queries.vocabulary("byte_bpe_50k.tiktoken"), bpe.PATTERN)
    spans = secret_scan.find_secrets(df, *args).first()["spans"]
    assert [(s["kind"], text[s["start"] : s["end"]]) for s in spans] == [("assign", "apiKey='aZ9dkq82JkQpLm2x"), ("random", "xoxb9A8f7Kq2Lp0ZtY3wVbN4mR6s")]
    out = secret_scan.redact(df, *args).first()
    assert out["text"].startswith("é [SECRET]' [SECRET] 550e") and out["n_chars"] == len(out["text"])


def quality_base(text):
    w = WORD.findall(text or "")
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(docs, odd, none):
    for df in (docs, odd, none):
        texts = defaultdict(list)
        for r in df.select("doc_id", "text").collect():
            texts[r["doc_id"]].append(r["text"])
        for r in quality_rules.quality_rules(df).collect():
            want = quality_base(texts[r["doc_id"]][0])
            assert tuple(r[c] for c in quality_rules.LONGS) == want
            assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r["base_failed"] and r["kept"])


def kneser_ney(texts, order=quality_rules.ORDER):
    """Byte model of one language in plain Python."""
    grams = Counter()
    for t in texts:
        b = bytes([2] * (order - 1)) + t.encode() + b"\x03"
        grams.update(b[i - order + 1 : i + 1] for i in range(order - 1, len(b)))
    levels = {order: grams}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    discounts, contexts = {}, {}
    for k, c in levels.items():
        n = Counter(c.values())
        n1, n2, n3, n4 = (n[i] for i in (1, 2, 3, 4))
        if min(n1, n2, n3, n4):
            y = n1 / (n1 + 2 * n2)
            d = [min(max(i - (i + 1) * y * b / a, 0.05), i - 0.05) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        else:
            d = [0.5, 0.75, 0.9]
        discounts[k] = d
        total = contexts[k] = defaultdict(lambda: [0, 0.0])
        for g, x in c.items():
            total[g[:-1]][0] += x
            total[g[:-1]][1] += d[min(x, 3) - 1]

    def prob(g):
        if not g:
            return 1 / 256
        k = len(g)
        lower = prob(g[1:])
        if g[:-1] not in contexts[k]:
            return lower
        total, off = contexts[k][g[:-1]]
        x = levels[k][g]
        return (x - discounts[k][min(x, 3) - 1] if x else 0) / total + off / total * lower

    return prob


def test_kneser_ney(spark):
    texts = ["the cat sat on the mat " * 3, "the dog sat on the log", "a mat and a log and a cat"]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    prob = kneser_ney(texts)
    got = {r["doc_id"]: r["bits"] for r in quality_rules.quality_rules(df).collect()}
    for i, t in enumerate(texts):
        b = bytes([2] * 4) + t.encode() + b"\x03"
        want = -sum(math.log2(prob(b[j - 4 : j + 1])) for j in range(4, len(b))) / (len(t) + 1)
        assert abs(got[i] - want) < 1e-4
    model = quality_rules._collected(*quality_rules._levels(df))
    for context in (b"the ", b"qqqq", b"on t"):
        keys = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)])
        assert abs(model.prob(np.zeros(256, np.int64), keys).sum() - 1) < 1e-4


def test_interpolated_scores(docs, odd, none):
    lower = {i: i + 32 for i in range(65, 91)}
    for df in (docs, odd, none):
        rows = [(r["doc_id"], [*WORD.findall((r["text"] or "").translate(lower)), "\0"]) for r in df.select("doc_id", "text").collect()]
        fold = lambda d: zlib.crc32(("" if d is None else str(d)).encode())
        c = Counter(w for d, ws in rows if fold(d) % 10 for w in ws)
        n, v = sum(c.values()), len(c)
        want = sorted((str(d), fold(d) % 10 == 0, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 4)) for d, ws in rows)
        got = interpolated_lm.score_texts(df, range_bytes=50_000).collect()
        have = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got)
        assert [x[:5] for x in have] == [x[:5] for x in want]
        assert np.allclose([x[5] for x in have], [x[5] for x in want], atol=1e-3)
        if len(rows) > 50:
            held = [r for r in got if r["held_out"]]
            assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # better than the base on unseen texts


def test_em_weights():
    import pandas as pd

    events = pd.DataFrame({"bucket": [3, 3, 5], "n": [90, 10, 50], "f2": [0.5, 0.0, 0.0], "f1": [0.01, 0.01, 0.02], "f0": [1e-4] * 3})
    w = interpolated_lm.learn(events)
    assert np.allclose(w.sum(1), 1) and w[3, 0] > 0.8 and w[5, 1] > 0.9


def test_weak_labels(docs, odd, none, spark, sf_dir):
    out = weak_labels.quality_classifier(docs, sample=500, rounds=10)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    met = out.join(labels, "doc_id")
    right = met.filter("kept = (quality = 1)").count() / met.count()
    assert out.count() == docs.count() and right > 0.85
    assert weak_labels.quality_classifier(odd, sample=50, rounds=2).count() == len(ODD)
    assert weak_labels.quality_classifier(none).count() == 0


def test_em_finds_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.8
    votes = np.stack([np.where(rng.random(len(truth)) < a, truth, ~truth) for a in (0.95, 0.8, 0.7, 0.6)], 1)
    patterns, counts = np.unique(np.where(votes, 1, 2), axis=0, return_counts=True)
    good, told, prior = weak_labels.estimate(patterns, counts.astype(float))
    assert abs(prior - 0.8) < 0.05 and abs(told[0, 0, 1] - 0.95) < 0.04


def test_mix(docs, odd, none):
    for df in (docs, odd, none):
        rows = pfair_mix.mix(df, block_docs=2, bucket_docs=10).collect()
        assert len(rows) == df.count()
        places = [(r["mix_slot"], r["mix_position"]) for r in rows]
        assert len(set(places)) == len(places)
        assert len({r["mix_slot"] for r in rows}) == max((r["mix_slot"] for r in rows), default=-1) + 1
    assert pfair_mix.mixed(docs).count() == docs.count()


def test_mix_follows_weights(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(900)], "doc_id long, source string")
    rows = pfair_mix.mix(df, {"a": 2.0, "b": 1.0, "c": 1.0}, block_docs=5).collect()
    order = sorted({(r["mix_slot"], r["source"]) for r in rows})
    for t in range(1, 113):  # seven whole frames, then the first source ends
        assert abs(sum(s == "a" for _, s in order[:t]) - t / 2) < 1


def test_chat(spark, sf_dir):
    from oracle import connect, same

    same(queries.QUERIES["op6_chat_rotation"](spark, sf_dir), connect(sf_dir), queries.ORACLE_SQL["op6_chat_rotation"])
    rows = [(1, 0, "ann", "hi <|im_end|>"), (1, 1, "bob", None), (1, None, None, "late"), (2, 0, "system", "only"), (None, 0, "ann", "x")]
    out = chat_rotation.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), chunk_turns=64)
    assert out.groupBy("conv_id").count().count() == 2
    first = out.filter("conv_id = 1 and speaker = 'ann' and chunk = 0").first()
    assert first["rendered"] == "<|im_start|>assistant\nhi < |im_end| ><|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n"
    (m,) = first["mask"]
    assert first["rendered"][m[0] : m[1]] == "hi < |im_end| ><|im_end|>"


def test_nearest(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in table.collect()}
    hit = total = 0
    got = defaultdict(list)
    for r in ann.nearest(table).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    for q in [i for i in rows if i % 100 == 0]:
        want = sorted((float(np.sqrt(((v - rows[q]) ** 2).sum())), i) for i, v in rows.items() if i != q)[:10]
        hit, total = hit + len({i for _, i in want} & {i for i, _ in got[q]}), total + 10
        assert all(abs(s - np.sqrt(((rows[i] - rows[q]) ** 2).sum())) < 1e-9 for i, s in got[q]) and len(got[q]) == 10
    assert hit / total >= 0.9


def test_nearest_odd(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 2.0]), (5, None), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [None, 1.0]), (9, [1.0]), (None, [1.0, 1.0]), (4, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in ann.nearest(df, k=2).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3, 0.0), (0, 2, 100, 0.0), (100, 1, 0, 0.0), (100, 2, 3, 0.0)]
    assert ann.nearest(df.filter("vec_id = 5")).count() == 0


def test_pipeline(spark, sf_dir, docs, odd):
    import corpus_pipeline

    state, kept = odd.select(docs.columns).union(docs.limit(120)), None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, state, sf_dir)
        if name == "quality rules":
            assert out.columns == docs.columns
            assert {r["doc_id"] for r in out.collect()} <= {r["doc_id"] for r in state.collect()}
        if name == "n-gram Jaccard join":
            ids = [r["doc_id"] for r in out.collect()]
            assert {c for _, c, _ in classes([(r["doc_id"], r["text"]) for r in state.collect()])} == set(ids)
        if name in ("secret scans", "mixing sources to target weights"):
            assert out.count() == state.count() and out.columns == docs.columns
        state, kept = spark.createDataFrame(out.collect(), out.schema), out.count()
    assert kept and json.dumps(state.columns)
