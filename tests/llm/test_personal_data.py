"""Personal data: base spans against the stated patterns, contexts against plain Python, and odd cases."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from blockyard.llm import personal_data as pd_

KINDS = ("email", "ip", "card", "phone")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(d[::2] + [2 * x - 9 if x > 4 else 2 * x for x in d[1::2]]) % 10 == 0


def digits(s):
    return sum(c.isdigit() for c in s)


PATTERNS = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= digits(m[0]) <= 19 and luhn(m[0])),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= digits(m[0]) <= 15),
]


def base(text):
    return [(k, *m.span()) for k, (p, ok) in enumerate(PATTERNS) for m in re.finditer(p, text) if ok(m)]


def plain(rows, least=3, rounds=3, confident=0.6):
    """Spans of every text: patterns are strings, candidates come from the module's byte pattern."""
    fold = lambda w: re.sub("[0-9]", "0", w.translate({i: i + 32 for i in range(65, 91)}))
    fills, seen = defaultdict(int), []
    for n, (_, text) in enumerate(rows):
        text = text or ""
        at = [m.span() for m in WORD.finditer(text)]
        words = [fold(text[a:b]) for a, b in at]
        get = lambda j: words[j] if 0 <= j < len(words) else ""  # noqa: B023, E731
        for j in range(len(words)):
            for p in ((2, get(j - 2), get(j - 1)), (1, get(j - 1)), (3, get(j - 1), get(j + 1))):
                fills[p] += 1
        raw = text.encode()
        point = lambda b: len(raw[:b].decode())  # noqa: B023, E731
        byte = lambda c: len(text[:c].encode())  # noqa: B023, E731
        for a, b, seed in pd_.candidates(raw, [(k, byte(x), byte(y)) for k, x, y in base(text)]):
            a, b = point(a), point(b)
            first = sum(e <= a for _, e in at)
            last = sum(s < b for s, _ in at)
            own = ((2, get(first - 2), get(first - 1)), (1, get(first - 1)), (3, get(first - 1), get(last)))
            seen.append((n, a, b, seed, text[a:b], own))
    edges, seeds = defaultdict(int), set()
    for _, _, _, seed, what, own in seen:
        for p in own:
            edges[p, what] += 1
        if seed:
            seeds.add(what)
    by = defaultdict(dict)
    for (p, what), c in edges.items():
        by[p][what] = c
    by = {p: own for p, own in by.items() if len(own) >= least}
    trust = {what: float(what in seeds) for own in by.values() for what in own}
    for _ in range(rounds):
        worth = {}
        for p, own in by.items():
            mass, support = sum(c * trust[w] for w, c in own.items()), sum(trust[w] for w in own)
            worth[p] = min(mass / (max(fills[p], sum(own.values())) + 1), 0.999) if support >= least else 0.0
        doubt = defaultdict(lambda: 1.0)
        for p, own in by.items():
            for w in own:
                doubt[w] *= 1 - worth[p]
        trust = {w: 1.0 if w in seeds else 1 - doubt[w] for w in trust}
    out = []
    for n, (doc_id, text) in enumerate(rows):
        more = sorted({(4, a, b) for m, a, b, seed, _, own in seen if m == n and not seed and any(worth.get(p, 0) >= confident for p in own)})
        out.append((doc_id, [(pd_.KINDS[k], a, b) for k, a, b in base(text or "") + more]))
    return sorted(out, key=str)


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted([(r["doc_id"], [tuple(s) for s in r["spans"]]) for r in pd_.find_personal(docs, **options).collect()], key=str)


def planted():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeéü") for _ in range(rng.randrange(2, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, prose(12)) for i in range(40)]
    rows += [(100 + i, f"{prose(3)} Contact Mail: {word()}.{i}@site{i}.example.com, {prose(2)}") for i in range(9)]
    rows += [(200 + i, f"{prose(2)} contact mail: AB{1000 + i}x {prose(2)}") for i in range(4)]  # learnt from the mails
    rows += [(300 + i, f"{prose(2)} member no. AB{1000 + i}x {prose(2)}") for i in range(4)]  # found ones teach a second context
    rows += [(400 + i, f"{prose(2)} member no. QQ-77{1000 + i} {prose(2)}") for i in range(2)]  # so these follow
    rows += [(500 + i, f"the {70000 + i} {word()}") for i in range(30)] + [(600 + i, f"the +1 (555) 555-01{10 + i} {word()}") for i in range(4)]  # mostly plain numbers: no pattern
    rows += [(700 + i, f"version {2000 + i} of the licence") for i in range(5)]
    return rows


def test_contexts_against_plain_python(spark):
    rows = planted()
    got = run(spark, rows)
    assert got == plain(rows)
    found = {d for d, spans in got if any(k == "context" for k, _, _ in spans)}
    assert {200, 201, 202, 203, 400, 401} <= found and not found & {*range(500, 530), *range(700, 705)}


def test_documents_against_plain_python(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert run(spark, rows) == plain(rows)


def test_odd_texts_nulls_repeats_and_clashing_names(spark):
    rows = [(None, None), (None, ""), (1, "@"), (1, "@@a@b.c@d.e"), (2, "1.2.3.4.5.6.7.8 001.002.0003.255 256.1.1.1"), (3, "x" * 3000 + "@mail.com"), (4, "9" * 2000), (5, "1.1 " * 300), (6, "é" * 9 + "a@b.cd+1 (234) 567-8901"), *([(7, "contact mail: ab1234")] * 5), *planted()]
    assert run(spark, rows) == plain(rows)
    docs = spark.createDataFrame([(1, "a@b.cd", 5, "old", 3)], "doc_id long, text string, _row long, spans string, _SEEN int")
    got = pd_.find_personal(docs)
    assert got.columns == ["doc_id", "text", "_row", "_SEEN", "spans"] and got.collect()[0]["_row"] == 5
    assert pd_.find_personal(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_base_spans_of_random_strings(seed):
    rng = random.Random(seed)
    for _ in range(4000):
        text = "".join(rng.choice("a0129..@@+- ()é4%") for _ in range(rng.randrange(40)))
        raw = text.encode()
        want = [(k, len(text[:a].encode()), len(text[:b].encode())) for k, a, b in base(text)]
        assert pd_.base_spans(raw) == want, text


def test_digests(spark):
    docs = spark.createDataFrame([(1, "é a@b.cd 10.0.0.1"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pd_.personal_digests(pd_.find_personal(docs)).collect()}
    assert got[1]["spans"] == "email:2:8,ip:9:17" and got[1]["n_email"] == got[1]["n_ip"] == 1 and got[2]["spans"] == ""
    assert got[1]["base_sha256"] == hashlib.sha256(b"email:2:8,ip:9:17").hexdigest()
