"""Random spans of the secret scan against a plain reading of the rules: runs, exclusions, URLs and characters per token."""

import base64
import random
import re

import tiktoken

from blockyard.llm import bpe, queries, secret_scan

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KEY = set(LETTERS + "0123456789+/_-")


def encoder():
    with open(queries.vocabulary("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(line.split()[0]): int(line.split()[1]) for line in f}
    return tiktoken.Encoding("plain", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def key_runs(text):
    """Maximal runs of key characters of 20 or more, with up to two signs of equality behind them."""
    i = 0
    while i < len(text):
        j = i
        while j < len(text) and text[j] in KEY:
            j += 1
        if j - i >= 20:
            k = j
            while k < len(text) and k < j + 2 and text[k] == "=":
                k += 1
            yield i, k
            j = k
        i = max(j, i + 1)


def cut_words(part):
    """A part of a name as words of one case and short numbers, longest first from the left; None if it is none."""
    out, i = [], 0
    while i < len(part):
        for ok in (lambda s: s.isalpha() and (s[:1].isupper() and len(s) >= 3 and s[1:].islower() or len(s) >= 2 and s.islower()), lambda s: len(s) >= 2 and s.isalpha() and s.isupper(), lambda s: len(s) <= 4 and s.isdigit()):
            ends = [j for j in range(i + 1, len(part) + 1) if part[i:j].isalnum() and ok(part[i:j])]
            if ends:
                out.append(part[i : ends[-1]])
                i = ends[-1]
                break
        else:
            return None
    return out


def known(run):
    bare = run.rstrip("=").strip("-_/+")
    low = bare.lower()
    groups = low.split("-")
    if [len(g) for g in groups] == [8, 4, 4, 4, 12] and all(c in "0123456789abcdef" for g in groups for c in g):
        return True
    if len(bare) in (32, 40, 48, 56, 64, 96, 128) and all(c in "0123456789abcdef" for c in low):
        return True
    if not any(c in LETTERS for c in bare):
        return True
    if not any(c.isdigit() for c in bare):
        return False
    for part in filter(None, re.split("[-_/+]", bare)):
        words = cut_words(part)
        if words is None or len(words) > 1 + len(part) // 5:
            return False
    return True


def hidden(text, at):
    """Whether a place lies in a URL's scheme, host or path; user, query and fragment are looked at."""
    for m in re.finditer(r"""[A-Za-z][A-Za-z0-9+.-]*://[^\s"'`<>,;|\\^{}()\[\]]*""", text):
        rest = m[0].index("://") + 3 + m.start()
        stop = next((i for i in range(rest, m.end()) if text[i] in "?#"), m.end())
        slash = next((i for i in range(rest, stop) if text[i] == "/"), stop)
        user = text.rfind("@", rest, slash)
        if (m.start() if user < 0 else user + 1) <= at < stop:
            return True
    return False


def plain(text, encoding, least=2.2):
    base = [s for s in secret_scan.scan(text, encoding, 0.0) if s[0] != "random"]  # the base has a test of its own
    out = []
    for a, b in key_runs(text):
        run = text[a:b]
        if known(run) or any(x < b and a < y for _, x, y in base) or hidden(text, a):
            continue
        tokens = sum(len(encoding.encode_ordinary(run[i : i + 256])) for i in range(0, len(run), 256))
        if len(run) / tokens < least:
            out.append((a, b))
    return out


def made(rng):
    chars = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    word = lambda: rng.choice(["user", "Config", "HTTP", "database", "value", "2024", "v2", "TheQuick", "brown"])
    kinds = [
        lambda: chars(LETTERS + "0123456789", rng.randrange(15, 60)), lambda: chars(LETTERS, 30), lambda: chars("0123456789abcdef", rng.choice([20, 32, 40, 64])).upper(),
        lambda: chars(LETTERS + "0123456789+/", 40) + "=" * rng.randrange(4), lambda: rng.choice("_-/").join(word() for _ in range(rng.randrange(2, 7))), lambda: chars("0123456789", 25),
        lambda: "-".join(chars("0123456789abcdef", n) for n in (8, 4, 4, 4, 12)), lambda: f"https://{chars(LETTERS, 30)}@host.example/{chars(LETTERS + '0123456789', 30)}?key={chars(LETTERS + '0123456789', 30)}#{chars(LETTERS, 25)}",
        lambda: "the quick brown fox", lambda: "é" * 3, lambda: f"a://{chars(LETTERS + '0123456789', 30)}/x", lambda: "aaaa" * rng.randrange(4, 90), lambda: chars(LETTERS + "0123456789", 700),
    ]
    return rng.choice(["", " "]).join(rng.choice([" ", "\n", ",", '"', "=", "(", ""]).join((rng.choice(kinds)(), rng.choice(kinds)())) for _ in range(rng.randrange(1, 6)))


def test_random_spans_of_made_texts():
    encoding, rng, seen = encoder(), random.Random(11), 0
    for _ in range(1500):
        text = made(rng)
        want = plain(text, encoding)
        assert [(a, b) for k, a, b in secret_scan.scan(text, encoding, 2.2) if k == "random"] == want, text
        seen += len(want)
    assert seen > 1000


def test_random_spans_of_documents(spark, sf_dir):
    encoding = encoder()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = secret_scan.find_secrets(docs, queries.vocabulary("byte_bpe_50k.tiktoken"), bpe.PATTERN).collect()
    for r in got:
        assert [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == "random"] == plain(r["text"] or "", encoding)
