"""Regions as vectors: numbers, flags and one-hot names, and hashed bags of the words of text and names.

The numbers are Columns; an Arrow step packs them and hashes words, once per distinct word of a batch.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import HINTS, TEXTS, WORD_BITS
from ..functions.taxonomy import TYPES
from ..functions.text import FNV_OFFSET, FNV_PRIME, bare_tag
from .rules import CORE

# Names of the slots, sizes of the hashed bags, words whose hashes a task keeps at hand.
NUMBERS = {
    "len": "text_length", "ltr": "if(t = 'a', 1.0, link_ratio)", "links": "links + if(t = 'a', 1, 0) + cover_links", "images": "images", "headings": "headings", "items": "list_items", "rows": "table_rows", "controls": "controls", "paragraphs": "paragraphs",
    "repeats": "repeats", "words": "words", "commas": "commas", "sentences": "sentences", "avgLine": "avg_line", "capsWords": "caps_words", "top": "page_fraction", "height": "height", "pos": "pos", "index": "idx", "repeatPages": "repeat_pages", "repeatFrac": "repeat_frac", "pagesOfSite": "site_pages",
    "lines": "lines", "widthFraction": "width_fraction", "leftFraction": "left_fraction", "frameW": "frame_width", "frameH": "frame_height", "imgMax": "image_area", "imgCount": "size(pictures)", "lenPerRepeat": "text_length / greatest(repeats, 1)", "textDensity": "text_length / greatest(height, 1)",
    "linksPerLine": "(links + if(t = 'a', 1, 0) + cover_links) / greatest(lines, 1)", "log1pLen": "log1p(text_length)", "prevLen": "prev_length", "nextLen": "next_length", "prevLinks": "prev_links", "nextLinks": "next_links",
}
FLAGS = {
    "run": "run", "bigImage": "big_image", "iconsOnly": "icons_only", "inHeader": "in_header", "inFooter": "in_footer", "inNav": "in_nav", "inMain": "in_main", "inAside": "in_aside", "inForm": "in_form", "inDialog": "in_dialog", "inSearch": "in_search", "aboveFold": "above_fold", "wide": "wide", "narrow": "narrow",
    "first": "first", "lastRegion": "last", "repeated": "repeated", "short": "short", "tiny": "tiny", "prose": "prose", "linky": "linky", "actionWord": "action_word", "firstProse": "first_prose", "prevTitleish": "prev_titleish",
    "frame": "frame_host is not null", "hasImages": "size(pictures) > 0", "prevHeading": "prev_tag rlike '^h[1-6]'", "nextHeading": "next_tag rlike '^h[1-6]'", "sameTagAsPrev": "prev_bare = t", "sameTagAsNext": "next_bare = t",
}
TAGS = "div p h1 h2 h3 h4 h5 h6 ul ol li a span section article header footer nav aside main table tbody tr td pre code blockquote figure img picture svg video audio canvas iframe form input button select textarea label dl hr font center strong b em small time summary details dialog other".split()
MARKS = ["none", *"header nav main article section aside footer form dialog role=banner role=navigation role=main role=contentinfo role=complementary role=search role=form role=dialog role=region".split()]
TEXT_BUCKETS, HINT_BUCKETS, HELD_WORDS = 256, 128, 1 << 19
ONE_HOT = {"tag": TAGS, "lm": MARKS, "rule": [*CORE.names(), "none"], "heur": list(TYPES)}

NAMES = [
    *(f"n:{k}" for k in NUMBERS), *(f"b:{k}" for k in FLAGS), *(f"h:{k}" for k in HINTS), *(f"t:{k}" for k in TEXTS),
    *(f"{group}:{k}" for group, names in ONE_HOT.items() for k in names if k != "none" or group != "rule"), *(f"w:{i}" for i in range(TEXT_BUCKETS)), *(f"c:{i}" for i in range(HINT_BUCKETS)),
]


def token_hash(word: str) -> int:
    """32-bit FNV-1a over the code points of a word, as ``functions.text.fnv1a``."""
    h = FNV_OFFSET
    for c in word:
        h = ((h ^ ord(c)) * FNV_PRIME) & 0xFFFFFFFF
    return h


def vectorize(calls: DataFrame) -> DataFrame:
    """Adds features, an array of ``NAMES`` slots, to classified regions (type and rule of the cascade and all region features).

    Absent numbers are 0, absent neighbours' lengths and links -1; text words count as shares of all words of the text.
    """
    spots = {n: i for i, n in enumerate(NAMES)}
    number = F.array(*(F.coalesce(F.expr(e).cast("float"), F.lit(0.0).cast("float")) for e in NUMBERS.values()), *(F.coalesce(F.expr(e).cast("float"), F.lit(0.0).cast("float")) for e in FLAGS.values()))
    known = lambda c, names, other: F.when(c.isin(names), c).otherwise(F.lit(other))
    ready = calls.withColumns({"prev_bare": bare_tag(F.col("prev_tag")), "next_bare": bare_tag(F.col("next_tag"))})
    ready = ready.withColumns({"_numbers": number, "_tag": known(F.col("t"), TAGS, "other"), "_mark": known(F.when(F.col("last_mark") == "", "none").otherwise(F.col("last_mark")), MARKS, "none")}).drop("prev_bare", "next_bare")
    used = ["_numbers", "_tag", "_mark"]
    keep = [c for c in ready.columns if c not in used]
    kinds = dict(ready.dtypes)
    bits = [("hints_0", 0, "h", list(HINTS)), ("hints_1", WORD_BITS, "h", list(HINTS)), ("texts_0", 0, "t", list(TEXTS))]
    dense, words_at, hints_at = len(NUMBERS) + len(FLAGS), spots["w:0"], spots["c:0"]

    def pack(batches):
        hashes: dict[str, int] = {}
        of = lambda w: hashes[w] if w in hashes else hashes.setdefault(w, token_hash(w))
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                n = batch.num_rows
                if len(hashes) > HELD_WORDS:
                    hashes.clear()
                v = np.zeros((n, len(NAMES)), np.float32)
                v[:, :dense] = np.array(batch.column("_numbers").to_pylist(), np.float32).reshape(n, dense)
                for column, base, kind, names in bits:
                    held = batch.column(column).to_numpy(zero_copy_only=False)
                    for k, name in enumerate(names[base : base + WORD_BITS]):
                        v[:, spots[f"{kind}:{name}"]] = (held >> k) & 1
                for column, group in (("_tag", "tag"), ("_mark", "lm"), ("rule", "rule"), ("type", "heur")):
                    for i, x in enumerate(batch.column(column).to_pylist()):
                        if (spot := spots.get(f"{group}:{x}")) is not None:
                            v[i, spot] = 1
                for i, (text, hint) in enumerate(zip(batch.column("low").to_pylist(), batch.column("hint").to_pylist())):
                    words = re.findall(r"[a-zÀ-ɏ]{2,}", text or "")
                    if words:
                        v[i, words_at : words_at + TEXT_BUCKETS] = np.bincount([of(w) % TEXT_BUCKETS for w in words], minlength=TEXT_BUCKETS) / len(words)
                    for w in re.findall(r"[a-z]{3,}", hint or ""):
                        v[i, hints_at + of(w) % HINT_BUCKETS] = 1
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, len(NAMES)), pa.int32()), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), flat], [*keep, "features"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", features array<float>"
    return ready.mapInArrow(pack, schema)
