"""Method results against plain Python: scores, verdicts, spans, neighbours, lexicon, the pipeline's tokens; clashing names."""

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from blockyard.llm import ann, bpe, chat_rotation, interpolated_lm, jaccard_join, pfair_mix, quality_rules, queries, secret_scan

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = "_id long, _digest long, _source string, _hash string, _bucket int, _rank int, _before int, _plan int, _own int, _i int, _text string, node string, comp string, block int, fold int, path long, _again int"


def lines(spark, sf_dir, n):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy(F.octet_length("text"), "doc_id").limit(n).collect()
    return [(r["doc_id"], r["text"]) for r in rows]


def test_interpolated_score(spark, sf_dir):
    """EM and the mixture in plain Python; only the rounding of the estimates that EM sees is taken over."""
    rows = lines(spark, sf_dir, 150)
    lower = {i: i + 32 for i in range(65, 91)}
    texts = [(d, [*WORD.findall(t.translate(lower)), "\0"]) for d, t in rows]
    fold = lambda d: 2 if (c := zlib.crc32(str(d).encode())) % 10 == 0 else 1 if c // 10 % 20 == 0 else 0

    def counted(keep):
        own = [ws for d, ws in texts if fold(d) in keep]
        return Counter(w for ws in own for w in ws), Counter(p for ws in own for p in zip(["\1", *ws], ws)), len(own)

    def estimates(word, pair, begins, ws):
        n, v = sum(word.values()), len(word)
        for u, w in zip(["\1", *ws], ws):
            cu = begins if u == "\1" else word[u]
            yield min(int(math.log2(cu + 1)), 23), pair[u, w] / max(cu, 1), word[w] / n, 1 / (v + 1)

    kept, every = counted({0}), counted({0, 1})
    near = lambda x: 2.0 ** (round(8 * math.log2(x)) / 8) if x else 0.0
    held = Counter((b, near(f2), near(f1), f0) for d, ws in texts if fold(d) == 1 for b, f2, f1, f0 in estimates(*kept, ws))

    def fitted(events):
        w = [0.4, 0.4, 0.2]
        for _ in range(60 if events else 0):
            sums = [0.0, 0.0, 0.0]
            for (_, *f), n in events.items():
                own = [a * b for a, b in zip(f, w)]
                for i in range(3):
                    sums[i] += n * own[i] / sum(own)
            w = [s / sum(events.values()) for s in sums]
        w = [max(x, 1e-6) for x in w]
        return [x / sum(w) for x in w]

    usual = fitted(held)
    weights = {b: fitted({k: n for k, n in held.items() if k[0] == b}) for b in {k[0] for k in held}}
    want = {d: sum(math.log10(sum(a * x for a, x in zip(weights.get(b, usual), f))) for b, *f in estimates(*every, ws)) for d, ws in texts}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in interpolated_lm.score_texts(df, range_bytes=20_000).collect()}
    assert held and got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-5 * max(1, abs(want[d])) for d in want)


def test_partitions_may_change_between_scans(spark, sf_dir):
    df = spark.createDataFrame(lines(spark, sf_dir, 40), "doc_id long, text string")
    moving = df.repartition(5).withColumn("r", F.rand()).repartition("r").drop("r")
    assert interpolated_lm.score_texts(moving).count() == 40


def test_quality_verdict(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = quality_rules.quality_rules(docs).collect()
    rank = lambda xs, p: sorted(xs)[max(math.ceil(p * len(xs)), 1) - 1]
    off = lambda r, mid: (r["bits"] - mid) * math.sqrt((s := r["word_chars"] + r["n_words"]) / (s + 3000))
    for lang in {r["lang"] for r in rows}:
        own = [r for r in rows if r["lang"] == lang]
        usable = [r for r in own if not r["base_failed"]]
        inside = lambda r: True
        if len(usable) >= 30:
            mid = rank([r["bits"] for r in usable], 0.5)
            low, high = (5.0 * rank([off(r, mid) for r in usable], p) for p in (0.25, 0.75))
            inside = lambda r, mid=mid, low=low, high=high: low <= off(r, mid) <= high
        assert all(r["kept"] == (not r["base_failed"] and inside(r)) for r in own)
    assert any(not r["kept"] and not r["base_failed"] for r in rows)


def test_base_spans_by_the_stated_patterns(spark, sf_dir):
    assign = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""")
    made = ["API_KEY='abcdef1' apikey:short token=\"x\" ToKeN : zzzzzz", "AKIA" + "A" * 15 + " AKIA" + "B7" * 9, "0" * 23 + " " + "f" * 24 + "G", "passwd=ſecret1 ſecret=abcdefgh apıkey=abcdefgh"]
    texts = lines(spark, sf_dir, 10_000) + list(enumerate(made, 10**6))
    found = secret_scan.find_secrets(spark.createDataFrame(texts, "doc_id long, text string"), queries.vocabulary("byte_bpe_50k.tiktoken"), bpe.PATTERN)
    for r in found.collect():
        t = r["text"]
        want = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert [(s["start"], secret_scan.KINDS.index(s["kind"]), s["end"]) for s in r["spans"] if s["kind"] != "random"] == sorted(want)


def test_recall_where_few_are_reranked(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((16_384, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>").repartition(2)
    got = {}
    for r in ann.nearest(df, every=800).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = 0
    for q in range(0, len(x), 800):
        d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(1)
        d[q] = np.inf
        hit += len(set(np.argsort(d, kind="stable")[:10].tolist()) & got[q])
    assert hit >= 0.9 * 10 * len(got)


def test_lexicon_is_never_empty(spark):
    rows = [(f"top{i}", 1 << 22) for i in range(50)] + [(f"mid{i}", 1 << 21) for i in range(300)] + [(f"low{i}", 5) for i in range(1000)]
    df = spark.createDataFrame(rows, "word string, n long")
    names = lambda n: Counter(r["word"][:3] for r in bpe._frequent(df, n).collect())
    assert names(5000) == Counter(top=50, mid=300, low=1000)
    assert names(200)["top"] == 50 and 100 < names(200)["mid"] <= 150
    assert 20 < names(40)["top"] <= 40 and names(40)["mid"] == 0


def test_chat_odd_tables(spark):
    kind = "conv_id long, turn long, role string, text string, said string, chunk int, at int"
    assert chat_rotation.rotate(spark.createDataFrame([], kind)).count() == 0
    rows = [(1, 9007199254740993, "a", "x" * 100_000, "", 1, 1), (1, 9007199254740993, "a", "x" * 100_000, "", 1, 1), (1, -1, "b", "", "", 0, 0)]
    out = {(r["speaker"], r["chunk"]): r for r in chat_rotation.rotate(spark.createDataFrame(rows, kind)).collect()}
    assert {c for _, c in out} == {-1, 9007199254740993 // 64} and out["a", 9007199254740993 // 64]["n_turns"] == 2


def test_clashing_names_pass_through(spark):
    names = [c.split()[0] for c in CLASH.split(", ")]
    more = ["a" if c.split()[1] == "string" else 7 for c in CLASH.split(", ")]
    texts = [(i, f"one two three four five six {i} password=abcdefgh{i}", "en", "s" + str(i % 3), 3) for i in range(40)]
    df = spark.createDataFrame([(*t, *more) for t in texts * 2], "doc_id long, text string, lang string, source string, n_chars long, " + CLASH)
    same = lambda out: out.columns == df.columns and {tuple(r[c] for c in names) for r in out.collect()} == {tuple(more)}
    assert same(pfair_mix.mixed(df)) and same(secret_scan.redact(df, queries.vocabulary("byte_bpe_50k.tiktoken"), bpe.PATTERN))
    assert same(jaccard_join.one_of_each(df)) and jaccard_join.one_of_each(df).count() == 40
    assert quality_rules.keep_good(df).count() == 0
    assert interpolated_lm.score_texts(df).count() == 80


def test_pipeline_of_an_empty_table_and_its_tokens(spark, sf_dir):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    state = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, state, sf_dir)
        state = spark.createDataFrame(out.collect(), out.schema)
    assert state.count() == 0
    library = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    library.no_truncation(), library.no_padding()
    few = docs.orderBy("doc_id").limit(40)
    texts = {r["doc_id"]: r["text"] or "" for r in few.collect()}
    got = corpus_pipeline.tokens(spark, few, sf_dir).collect()
    assert {r["doc_id"]: list(r["ids"]) for r in got} == {d: library.encode(t, add_special_tokens=False).ids for d, t in texts.items()}
    assert sorted(r["mix_position"] for r in got) == sorted({r["mix_position"] for r in got})
