"""Secret scans: fixed patterns, and strings that cost a tokenizer many tokens.

Words of any language get long tokens from a BPE vocabulary; keys drawn at random do not. A run of key characters with
letters whose characters per token fall below ``least_ratio`` is a finding, unless it is a digest of a known length, a
UUID, a number, part of a URL's host or path, or a name made of words and numbers. User, query and fragment of a URL are
looked at like other text.
"""

from __future__ import annotations

import base64
import bisect
import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .scratch import fresh, small_batches

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
UUID = re.compile(r"(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})")
DIGEST = re.compile(r"(?i:[0-9a-f]+)")
DIGEST_LENGTHS = frozenset((32, 40, 48, 56, 64, 96, 128))  # fixed values: hex digits of common digests
URL = re.compile(r"""[A-Za-z][A-Za-z0-9+.-]*://[^\s"'`<>,;|\\^{}()\[\]]*""")
NAME_PART = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{2,}|[0-9]{1,4}")
CHUNK = 256


@functools.lru_cache(1)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def named(run: str) -> bool:
    """Known digests, identifiers and names, which are no secrets."""
    bare = run.rstrip("=").strip("-_/+")
    if UUID.fullmatch(bare) or (len(bare) in DIGEST_LENGTHS and DIGEST.fullmatch(bare)):
        return True
    if not re.search("[A-Za-z]", bare):
        return True
    if not re.search("[0-9]", bare):
        return False
    parts = [p for p in re.split(r"[-_/+]", bare) if p]
    return all("".join(NAME_PART.findall(p)) == p and len(NAME_PART.findall(p)) <= 1 + len(p) // 5 for p in parts)


def places(text: str) -> list[tuple[int, int]]:
    """Spans of the hosts and paths of a text's URLs."""
    out = []
    for m in URL.finditer(text) if "://" in text else ():
        a = m.start() + m[0].index("://") + 3
        host = re.compile("[^/?#]*").match(text, a, m.end())
        begin = host.start() + host[0].rindex("@") + 1 if "@" in host[0] else m.start()
        out.append((begin, re.compile("[^?#]*").match(text, a, m.end()).end()))
    return out


def chars_per_token(run: str, encoding) -> float:
    return len(run) / max(1, sum(len(encoding.encode_ordinary(run[i : i + CHUNK])) for i in range(0, len(run), CHUNK)))


def scan(text: str, encoding, least_ratio: float) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then by kind."""
    found = []
    low = text.lower()
    if any(k in low for k in ("password", "passwd", "secret", "token", "api")):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in LONG_HEX.finditer(text)]
    known, urls = list(found), places(text)
    starts = [a for a, _ in urls]
    for m in RUN.finditer(text):
        a, b = m.span()
        if named(m[0]) or any(x < b and a < y for _, x, y in known):
            continue
        near = bisect.bisect_right(starts, a) - 1
        if not (near >= 0 and a < urls[near][1]) and chars_per_token(m[0], encoding) < least_ratio:
            found.append(("random", a, b))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def find_secrets(docs: DataFrame, ranks: str, pattern: str, least_ratio: float = 2.2) -> DataFrame:
    """The columns of ``docs`` with spans, an array of (kind, start, end) in code points, end exclusive.

    ``ranks`` is the path of a tiktoken vocabulary and ``pattern`` its split pattern. A null text is empty and has no
    spans. An older column spans is replaced; rows, repeated ones too, and all other columns pass through.
    """
    docs = docs.drop("spans")
    small_batches(docs.sparkSession)
    with open(ranks, "rb") as f:
        table = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        encoding = _encoding(table.value, pattern)
        for batch in tn.slices(batches):
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in scan(t, encoding, least_ratio)] if t else [] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], [*batch.schema.names, "spans"])

    schema = ", ".join([f"`{n}` {t}" for n, t in docs.dtypes] + ["spans array<struct<kind:string,start:bigint,end:bigint>>"])
    return docs.mapInArrow(run, schema)


def secret_digests(found: DataFrame) -> DataFrame:
    """Counts by kind, digest of the base spans and all spans as text, for ``find_secrets``'s rows."""
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.sha2(told(F.filter("spans", lambda s: s["kind"] != "random")), 256).alias("base_sha256")
    return found.select("doc_id", *(count(k) for k in KINDS), base, told(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, ranks: str, pattern: str, mask: str = "[SECRET]", **options) -> DataFrame:
    """The rows of ``docs`` with every span of text replaced by ``mask`` (overlapping spans by one), n_chars kept in step."""
    found = find_secrets(docs, ranks, pattern, **options)
    # Spans come by start: each piece of clean text runs from the furthest end so far to the next start.
    state = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def step(acc, s):
        clean = F.substring(F.col("text"), acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int"))
        fresh = F.struct(F.concat(acc["out"], clean, F.lit(mask)).alias("out"), s["end"].alias("at"))
        wider = F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))
        return F.when((s["start"] < acc["at"]), wider).otherwise(fresh)

    done = F.aggregate("spans", state, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"].cast("int") + 1, F.length("text"))))
    text = F.when(F.size("spans") > 0, done).otherwise(F.col("text"))
    (new,) = fresh(found, "_text")
    out = found.withColumn(new, text)
    changed = {"text": F.col(new)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size("spans") > 0, F.length(new).cast("long")).otherwise(F.col("n_chars"))
    return out.withColumns(changed).select(*docs.columns)
