"""Regions of stored pages: each page's elements are cut into leaf regions inside Spark tasks.

Pages go through ``mapInPandas`` in small batches, dealt by bytes first. With ``data-mx-r="left,top,width,height"`` on the
elements the tests on sizes use it; without, texts and the width and height of images and frames alone decide.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Callable, Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import host
from .page_tree import CONTROLS, HEADINGS, LANDMARKS, PICTURES, ROLES, SKIP, VOID, Page

# Tags that are leaves, tags of rows, and sizes that the segmentation goes by.
LEAVES = frozenset("p ul ol dl pre blockquote figure img video audio picture canvas svg iframe form h1 h2 h3 h4 h5 h6 hr textarea select button input".split())
ROW_TAGS = frozenset("li tr article section dt dd".split())
DIRECT_CHARS, DIRECT_SHARE, SMALL_CHARS, SMALL_PX, DEEPEST, ROW_SHARE, ROW_CHARS, TINY_CHARS, TINY_PX = 80, 0.3, 700, 480, 20, 0.6, 2800, 60, 64
TITLE_CUT, LEAST_TITLE, LEAST_FRAME, LEAST_PICTURE = r" [|–—·-] ", 12, 80, 8

REGION = (
    "page_id long, url string, idx int, tag string, id string, class string, role string, aria_label string, landmarks array<string>, text string, text_length int, "
    "links int, images int, headings int, list_items int, table_rows int, controls int, paragraphs int, repeats int, cover_links int, cover_label string, link_ratio double, "
    "pictures array<struct<kind:string,alt:string,width:int,height:int>>, frame_host string, frame_width int, frame_height int, frame_title string, "
    "top int, height int, width_fraction double, left_fraction double, page_fraction double, above_fold boolean, geometry_source string, page_title string"
)


def _low(page: Page, i: int, limit: float) -> bool:
    return page.box[i] is None or page.box[i][3] < limit


def _data_table(page: Page, i: int) -> bool:
    """Whether a table declares headers or has rows of one shape; other tables are layout."""
    if page.count("tables", i):
        return False
    if page.count("th", i):
        return True
    widths = [n for r in page.below(i, "tr") if (n := sum(page.tag[c] in ("td", "th") for c in page.children(r)))]
    return len(widths) >= 3 and widths[0] >= 2 and set(widths) == {widths[0]}


class Cutter:
    """Cuts one page into leaves: lists of elements, each with the element under the split parent that it hangs from."""

    def __init__(self, page: Page):
        self.page, self.leaves = page, []
        prefix = re.split(TITLE_CUT, page.title)[0].strip()[:40]
        self.prefix = prefix if len(prefix) >= LEAST_TITLE else None

    def titled(self, i: int) -> bool:
        return self.prefix is not None and self.prefix in self.page.text(i)

    def tiny(self, i: int) -> bool:
        p = self.page
        tall = not _low(p, i, TINY_PX) or (p.box[i] is None and (p.is_a("tall", i) or p.count("tall", i)))
        small = p.length[i] < TINY_CHARS and not tall and p.tag[i] not in HEADINGS
        return small and not p.count("solid", i) and p.count("links", i) <= 1 and not self.titled(i)

    def rows(self, kids: list[int]) -> str | None:
        """The signature that most children share, if these are alike enough to be rows of a list."""
        p, names = self.page, [self.page.signature(k) for k in kids]
        if len(kids) < 3:
            return None
        best, n = Counter(names).most_common(1)[0]
        of = [k for k, name in zip(kids, names) if name == best]
        if n < ROW_SHARE * len(kids) or not (best.split(".", 1)[1] or p.tag[of[0]] in ROW_TAGS) or any(p.count("landmarks", k) for k in of):
            return None
        lengths = sorted(p.length[k] for k in of)
        alike = lengths[-1] < ROW_CHARS or (n >= 6 and lengths[min(n - 1, int(0.9 * n))] < ROW_CHARS)
        return best if alike and sum(x > 0 for x in lengths) >= 3 else None

    def enter(self, i: int, depth: int, top: int, todo: list) -> None:
        """Make i a leaf, or leave its children to do."""
        p = self.page
        while True:
            if not p.seen[i]:
                return
            whole = _data_table(p, i) if p.tag[i] == "table" else p.tag[i] in LEAVES
            kids = [] if whole else p.kids(i)
            prose = p.direct[i] >= DIRECT_CHARS or (p.direct[i] > 0 and p.direct[i] >= DIRECT_SHARE * p.length[i])
            if not kids or prose:
                self.leaves.append([[i], top])
                return
            if len(kids) > 1 or p.tag[i] in LANDMARKS:
                break
            i = kids[0]
        zone = len(kids) > 1 and (p.count("h1", i) or (p.length[i] < SMALL_CHARS and self.titled(i)))
        if (depth > 0 and p.length[i] < SMALL_CHARS and _low(p, i, SMALL_PX) and not zone) or depth > DEEPEST:
            self.leaves.append([[i], top])
            return
        todo.append({"kids": kids, "next": 0, "depth": depth, "top": top, "row": self.rows(kids), "held": [], "last": -1, "since": None})

    def cut(self) -> list[list]:
        todo: list[dict] = []
        self.enter(self.page.body(), 0, self.page.body(), todo)
        while todo:
            at = todo[-1]
            if at["since"] is not None:  # the leaves of the child entered last
                if len(self.leaves) > at["since"]:
                    self.leaves[at["since"]][0][:0] = at["held"]
                    at["held"], at["last"] = [], len(self.leaves) - 1
                at["since"] = None
            if at["next"] == len(at["kids"]):
                if at["held"] and at["last"] >= 0:
                    self.leaves[at["last"]][0].extend(at["held"])
                elif at["held"]:
                    self.leaves.append([at["held"], at["top"]])
                todo.pop()
                continue
            k = at["kids"][at["next"]]
            at["next"] += 1
            if at["row"] and self.page.signature(k) == at["row"]:
                self.leaves.append([[*at["held"], k], k])
                at["held"], at["last"] = [], len(self.leaves) - 1
            elif len(at["kids"]) > 1 and self.tiny(k):
                at["held"].append(k)
            else:
                at["since"] = len(self.leaves)
                self.enter(k, at["depth"] + 1, k, todo)
        return self.leaves


def merge_runs(page: Page, leaves: list[list]) -> list[tuple[list[int], int]]:
    """Elements and number of siblings of each region: neighbouring leaves of one element and signature become one."""
    out: list[tuple[list[int], list[int]]] = []
    for els, top in leaves:
        if out and len(els) == 1:
            last, tops = out[-1]
            if len(last) == len(tops) and page.signature(last[-1]) == page.signature(els[0]) and page.before[top] == tops[-1]:
                last.append(els[0]), tops.append(top)
                continue
        out.append((list(els), [top]))
    return [(els, len(tops)) for els, tops in out]


def _size(page: Page, i: int, default: tuple = (None, None)) -> tuple:
    """Width and height: of the box, or of the attributes."""
    if page.box[i]:
        return tuple(round(x) for x in page.box[i][2:])
    found = [re.match(r"\d+", page.attrs[i].get(k, "")) for k in ("width", "height")]
    return tuple(int(m[0]) if m else d for m, d in zip(found, default))


def _pictures(page: Page, els: list[int]) -> list[dict]:
    out = []
    for e in els:
        own = [e] if page.tag[e] in PICTURES else page.below(e, *PICTURES)
        for i in own:
            width, height = _size(page, i)
            if min(LEAST_PICTURE if x is None else x for x in (width, height)) < LEAST_PICTURE:
                continue
            alt = next((v for k in ("alt", "title", "aria-label") if (v := page.attrs[i].get(k, ""))), "")
            out.append({"kind": page.tag[i], "alt": alt.strip(), "width": width, "height": height})
    return sorted(out, key=lambda x: -(x["width"] or 0) * (x["height"] or 0))


def _covering(page: Page, els: list[int], area: float) -> list[int]:
    """Anchors around a region, and those inside that are as large as a member of it."""
    around = [next((k for k in page.up(e)[1:] if page.is_a("links", k)), None) for e in els]
    inside = [k for e in els for k in page.below(e, "a") if page.is_a("links", k) and page.box[k] and page.box[k][2] * page.box[k][3] >= 0.4 * area / len(els)]
    return list(dict.fromkeys([*(k for k in around[:1] if k is not None), *inside, *(k for k in around if k is not None)]))


def describe(page: Page, cutter: Cutter, els: list[int], repeats: int, start: float, view: tuple[int, int]) -> dict:
    """What is told of a region; ``start``: the share of the page's text before it."""
    main = els[0] if repeats > 1 else next((e for e in els if not cutter.tiny(e)), els[0])
    own = lambda k: page.attrs[main].get(k) or None
    text = "\n".join(page.text(e) for e in els).strip()
    chain = [page.tag[k] if page.tag[k] in LANDMARKS else f"role={role}" for k in page.up(main) if page.tag[k] in LANDMARKS or (role := page.attrs[k].get("role")) in ROLES]
    boxes = [page.box[e] for e in (els[0], els[-1]) if page.box[e]]
    whole = page.box[page.body()]
    pictures = _pictures(page, els)
    out = {k: sum(page.count(k, e) for e in els) for k in ("links", "headings", "list_items", "table_rows", "controls", "paragraphs")}
    for k in ("headings", "controls", "paragraphs"):
        out[k] += sum(page.is_a(k, e) for e in els)
    out |= {
        "tag": page.tag[main] + (f"×{len(els)}" if repeats > 1 else ""), "id": own("id"), "class": " ".join(page.attrs[main].get("class", "").split()) or None, "role": own("role"), "aria_label": own("aria-label"),
        "landmarks": chain[::-1], "text": text, "text_length": len(text), "repeats": repeats, "images": len(pictures), "pictures": pictures,
        "link_ratio": round(sum(page.link_text(e) for e in els) / len(text), 2) if text else 0.0, "frame_host": None, "frame_width": None, "frame_height": None, "frame_title": None,
        "top": None, "height": None, "width_fraction": 1.0, "left_fraction": 0.0, "page_fraction": round(start, 2), "above_fold": None, "geometry_source": "text", "page_title": page.title or None,
    }
    area = 1.0
    if boxes:
        left, top = min(b[0] for b in boxes), min(b[1] for b in boxes)
        width, height = max(b[0] + b[2] for b in boxes) - left, max(b[1] + b[3] for b in boxes) - top
        wide, tall = (whole[2] or view[0], whole[3] or 1) if whole else (view[0], max(top + height, 1))
        area = max(1.0, width * height)
        out |= {"top": round(top), "height": round(height), "width_fraction": round(min(width, wide) / wide, 2), "left_fraction": round(left / wide, 2), "page_fraction": round(top / tall, 2), "above_fold": top < view[1], "geometry_source": "boxes"}
    covering = _covering(page, els, area)
    labels = ((page.attrs[k].get("aria-label") or page.attrs[k].get("title") or "").strip() for k in covering)
    out |= {"cover_links": len(covering), "cover_label": next(filter(None, labels), None)}
    frame = next((e for e in els if page.tag[e] == "iframe"), None)
    if frame is None and len(els) == 1:
        frame = next(iter(page.below(els[0], "iframe")), None)
    if frame is not None:
        name = re.match(r"(?:[a-z]+:)?//([^/?#]*)", page.attrs[frame].get("src", ""))
        width, height = _size(page, frame, (300, 150))
        out |= {"frame_host": name[1].removeprefix("www.") if name else "", "frame_width": width, "frame_height": height, "frame_title": page.attrs[frame].get("title") or None}
    return out


def _told(row: dict) -> bool:
    """Whether a region has anything to show; ``regions.drop_empty`` says the same of rows."""
    frame = (row["frame_width"] or 0) >= LEAST_FRAME and (row["frame_height"] or 0) >= LEAST_FRAME
    return row["text_length"] > 0 or row["images"] > 0 or row["controls"] > 0 or frame


def cut_page(source: str | None, runs: bool = True, view: tuple[int, int] = (1280, 800)) -> tuple[Page, list[tuple[list[int], dict]]]:
    """The page's elements, and the elements and description of each of its regions."""
    page = Page(source)
    cutter = Cutter(page)
    leaves = cutter.cut()
    merged = merge_runs(page, leaves) if runs else [(els, 1) for els, _ in leaves]
    total, out = max(page.length[page.body()], 1), []
    for els, repeats in merged:
        out.append((els, describe(page, cutter, els, repeats, min(page.first[els[0]] / total, 1.0), view)))
    return page, out


def page_regions(source: str | None, runs: bool = True) -> list[dict]:
    """The regions of one page."""
    return [row for _, row in cut_page(source, runs)[1]]


def by_bytes(pages: DataFrame, each: int = 1 << 25) -> DataFrame:
    """``pages`` dealt out so that long pages do not meet in one task: partitions follow the bytes of all html."""
    total = pages.agg(F.sum(F.octet_length("html")).alias("b")).first()["b"] or 0
    parts = max(pages.sparkSession.sparkContext.defaultParallelism, -(-total // each))
    return pages.repartition(int(parts))


def over_pages(pages: DataFrame, each: Callable, schema: str, at_once: int = 64) -> DataFrame:
    """Rows (tuples in the order of ``schema``) that ``each`` makes of every page; frames of few pages, for pages may be long."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = re.findall(r"(?:^|, )(\w+) ", re.sub(r"<[^<>]*(<[^<>]*>)?[^<>]*>", "", schema))
        for frame in frames:
            for at in range(0, len(frame), at_once):
                rows = [r for page in frame.iloc[at : at + at_once].itertuples() for r in each(page)]
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return pages.mapInPandas(run, schema)


def extract_regions(pages: DataFrame, runs: bool = True, view: tuple[int, int] = (1280, 800)) -> DataFrame:
    """A row per region of pages (page_id, url, html), numbered by idx within the page; see REGION for the columns.

    Null or empty html has no region. ``view`` is the size of the window that pages were seen in.
    """
    names = re.findall(r"(?:^|, )(\w+) ", re.sub(r"<[^>]*>", "", re.sub(r"<struct<[^>]*>>", "", REGION)))

    def each(page):
        for i, (_, row) in enumerate(cut_page(page.html, runs, view)[1]):
            row |= {"page_id": page.page_id, "url": page.url, "idx": i}
            yield tuple(row[n] for n in names)

    return over_pages(by_bytes(pages.select("page_id", "url", "html")), each, REGION).withColumn("site", host(F.col("url")))


def append_frames(regions: DataFrame, pages: DataFrame) -> DataFrame:
    """``regions`` with the visible frames of at least 80 by 80 that their pages hold and they lack, by top and height.

    New ones follow the page's last region in the order of the page; a second call adds none. Only frames with a box count.
    """
    kind = dict(regions.dtypes)
    tags = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?i)<iframe([^>]*)>"), F.lit(1))).alias("pos", "a"))
    attr = lambda name: F.when(F.col("a").rlike(f' {name}="[^"]+"'), F.left(F.regexp_extract("a", f' {name}="([^"]*)"', 1), F.lit(80)))
    px = F.transform(F.split(F.regexp_extract("a", r'data-mx-r="([^"]*)"', 1), ","), lambda x: x.try_cast("double"))
    found = tags.filter(~F.col("a").contains('data-mx-h="1"')).withColumn("px", px).filter("size(px) = 4 and px[2] >= 80 and px[3] >= 80")
    last = regions.groupBy("page_id").agg(F.max("idx").alias("last"), F.first("site").alias("site"))
    found = found.join(last, "page_id", "left").withColumns({"top": F.round(F.col("px")[1]).cast("int"), "height": F.round(F.col("px")[3]).cast("int")})
    have = regions.filter("frame_host is not null").select("page_id", "top", "height").distinct()
    new = found.join(have, ["page_id", "top", "height"], "left_anti")
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))
    src = F.regexp_extract("a", r'src="([^"]*)"', 1)
    rows = new.withColumns(
        {
            "idx": F.coalesce("last", F.lit(-1)) + place, "tag": F.lit("iframe"), "id": attr("id"), "class": attr("class"), "role": attr("role"), "aria_label": attr("aria-label"), "landmarks": F.array().cast("array<string>"), "text": F.lit(""),
            "frame_host": F.coalesce(host(F.when(src.startswith("//"), F.concat(F.lit("https:"), src)).otherwise(src)), F.lit("")), "frame_width": F.col("px")[2], "frame_height": F.col("px")[3], "frame_title": attr("title"), "repeats": F.lit(1), "link_ratio": F.lit(0.0),
            "geometry_source": F.lit("boxes"), "site": F.coalesce("site", host(F.col("url"))),
        }
    )
    zero = ("text_length", "links", "images", "headings", "list_items", "table_rows", "controls", "paragraphs", "cover_links")
    rows = rows.select(*((F.lit(0) if c in zero else F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in kind.items()))
    return regions.unionByName(rows)


def page_text(pages: DataFrame, most: int = 20_000) -> DataFrame:
    """(page_id, text, chars, truncated, via_shadow): the longest of main, article or role=main if it has half of the body's text, else the body.

    A page of under 200 characters with shadow templates gives their texts instead, each once.
    """

    def each(row):
        page = Page(row.html)
        body = page.body()
        plain = lambda i: re.sub(r"\n{3,}", "\n\n", page.text(i))
        mains = [i for i in range(body, page.end[body]) if (page.tag[i] in ("main", "article") or page.attrs[i].get("role") == "main") and not page.mute[i]]
        best = max(mains, key=lambda i: page.length[i], default=body)
        text, shadow = plain(best if page.length[best] >= 0.5 * page.length[body] else body), False
        hosts = [i for i in range(len(page.tag)) if page.tag[i] == "template" and page.shadow[i]]
        if len(text) < 200 and hosts:
            parts = list(dict.fromkeys(filter(None, map(plain, hosts))))
            text, shadow = ("\n".join(parts), True) if parts else (text, False)
        yield row.page_id, text[:most], len(text), len(text) > most, shadow

    return over_pages(by_bytes(pages.select("page_id", "html")), each, "page_id long, text string, chars long, truncated boolean, via_shadow boolean")


# Roles of elements that can be used, and tags that hold text.
INTERACTIVE_TAGS = frozenset("button input select textarea summary".split())
INTERACTIVE_ROLES = frozenset("button link tab checkbox radio menuitem option switch searchbox textbox combobox".split())
TEXTISH = frozenset("p li td th dt dd blockquote figcaption pre label article".split())
ELEMENT = "page_id long, pos int, last int, role string, label string, href string, value string, checked boolean, expanded string, disabled boolean, interactive boolean, heading boolean, textish boolean, top long, said string"


def all_elements(pages: DataFrame) -> DataFrame:
    """A row per visible element of every page: number, number of the last one inside it, role, label, state and what is said of it."""

    def each(row):
        page = Page(row.html)
        by_id = {a["id"]: i for i, a in reversed(list(enumerate(page.attrs))) if a.get("id")}
        labels = {a["for"]: i for i, a in reversed(list(enumerate(page.attrs))) if page.tag[i] == "label" and a.get("for")}
        flat = lambda s: " ".join((s or "").split())
        inside = [i for i in range(page.body(), page.end[page.body()]) if not page.mute[i]]
        shown: dict[int, bool] = {}
        for i in inside:
            shown[i] = page.seen[i] and shown.get(page.parent[i], True)
            if not shown[i] or i == page.body():
                continue
            tag, a = page.tag[i], page.attrs[i]
            input_type = a.get("type") or "text"
            plain = {"a": "link" if "href" in a else "generic", "input": input_type, "img": "image"}
            role = a.get("role") or plain.get(tag) or ("heading" if tag in HEADINGS else tag)
            heading = tag in HEADINGS or a.get("role") == "heading"
            use = (tag == "a" and "href" in a) or tag in INTERACTIVE_TAGS or a.get("role") in INTERACTIVE_ROLES or a.get("contenteditable") in ("", "true") or "onclick" in a or ("tabindex" in a and a["tabindex"] != "-1")
            textish = (tag in TEXTISH or (tag == "span" and "role" in a) or (tag == "div" and page.tag[page.parent[i]] == "section")) and page.length[i] > 1
            text = page.text(i)
            label = flat(a.get("aria-label")) or flat(" ".join(page.text(by_id[k]) for k in a.get("aria-labelledby", "").split() if k in by_id))
            label = label or (flat(page.text(labels[a["id"]])) if tag == "input" and a.get("id") in labels else "") or flat(text) or next((v for k in ("title", "placeholder", "alt", "value") if (v := flat(a.get(k)))), "")
            href = urljoin(row.url or "", a["href"])[:300] if tag == "a" and a.get("href") else None
            field = tag in ("input", "textarea")
            value = (a.get("value") or (text if tag == "textarea" else ""))[:200] if field else None
            checked = "checked" in a if field and input_type in ("checkbox", "radio") else None
            said = " ".join(filter(None, [*(a.get(k) for k in ("aria-label", "title", "placeholder", "alt", "name", "value")), text])).lower()
            yield row.page_id, i, page.end[i] - 1, role, label[:200], href, value, checked, a.get("aria-expanded") or None, "disabled" in a, use, heading, textish, round(page.box[i][1]) if page.box[i] else None, said

    return over_pages(by_bytes(pages.select("page_id", "url", "html")), each, ELEMENT, at_once=4)


def page_elements(pages: DataFrame, filter: str = "interactive", max_items: int = 300) -> DataFrame:
    """(page_id, place, role, label, href, value, checked, expanded, disabled): what can be used on a page, and its headings.

    With ``filter='all'`` also elements that hold text. Elements that are neither labelled nor usable are left out, equal
    ones (role, label, top) count once, the first ``max_items`` of a page stay.
    """
    wanted = F.col("interactive") | F.col("heading") | (F.col("textish") if filter == "all" else F.lit(False))
    kept = all_elements(pages).filter(wanted & ((F.col("label") != "") | F.col("interactive")))
    columns = ["role", "label", "href", "value", "checked", "expanded", "disabled"]
    once = kept.groupBy("page_id", "role", "label", "top").agg(F.min_by(F.struct(*(c for c in columns if c not in ("role", "label"))), "pos").alias("own"), F.min("pos").alias("pos"))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))
    return once.withColumn("place", place).filter(F.col("place") <= max_items).select("page_id", "place", "role", "label", "own.*")


def find_elements(pages: DataFrame, query: str, max_items: int = 20) -> DataFrame:
    """(page_id, place, pos, role, label): the innermost elements that say ``query`` in any case, ``max_items`` a page.

    Elements come in document order, so one that holds another hit is followed by a hit inside it.
    """
    hits = all_elements(pages).filter(F.contains("said", F.lit(query.lower())))
    page = Window.partitionBy("page_id").orderBy("pos")
    inner = hits.withColumn("next", F.lead("pos").over(page)).filter("next is null or next > last")
    return inner.withColumn("place", F.row_number().over(page)).filter(F.col("place") <= max_items).select("page_id", "place", "pos", "role", "label")


# Attributes that cleaned blocks keep, tags they lose, and where lazy images have their source.
KEPT_ATTRIBUTES = frozenset(
    "href src srcset sizes alt title width height colspan rowspan datetime type value name placeholder checked disabled lang dir start reversed open controls poster loading cite headers scope abbr label for rel target".split()
)
STRIPPED = frozenset("script style link noscript template meta object embed".split())
LAZY_SOURCES, LAZY_SETS = ("data-src", "data-lazy-src", "data-original"), ("data-srcset", "data-lazy-srcset")
CONTROL_TYPES = r"form|search|login|settings|filters|poll|feedback"


def cleaned(page: Page, i: int, url: str, frames: bool, controls: bool) -> str:
    """The markup of an element without scripts, handlers and foreign attributes; links are absolute, lazy images loaded."""
    out: list[str] = []
    todo: list = [i]
    while todo:
        at = todo.pop()
        if isinstance(at, str):
            out.append(at)
            continue
        tag, a = page.tag[at], page.attrs[at]
        shadow = tag == "template" and page.shadow[at] and "shadowrootmode" in a
        if (tag in STRIPPED and not shadow) or (tag in ("iframe", "svg") and not frames) or (tag in CONTROLS and not controls):
            continue
        kept = {k: v for k, v in a.items() if k in KEPT_ATTRIBUTES and not k.startswith("on")}
        if tag == "img":
            kept.pop("loading", None)
            if not kept.get("src") or re.match(r"data:image/(gif|svg)", kept["src"]):
                kept |= {"src": v for v in [next((a[k] for k in LAZY_SOURCES if a.get(k)), None)] if v}
            if not kept.get("srcset"):
                kept |= {"srcset": v for v in [next((a[k] for k in LAZY_SETS if a.get(k)), None)] if v}
        if tag == "a" and kept.get("href"):
            kept["href"] = urljoin(url, kept["href"])
        inner = [p if isinstance(p, int) else entities.escape(p, quote=False) for p in page.parts[at]]
        if not shadow:
            out.append("<" + tag + "".join(f' {k}="{entities.escape(v)}"' for k, v in kept.items()) + ">")
            inner += [] if tag in VOID else [f"</{tag}>"]
        todo.extend(reversed(inner))
    return "".join(out)


def clean_blocks(pages: DataFrame, calls: DataFrame) -> DataFrame:
    """(page_id, idx, block, type, html): the cleaned markup of every region called (page_id, idx, block, type; idx as ``drop_empty`` numbers them).

    Frames and drawings stay in media blocks only, controls in control blocks only.
    """
    told = calls.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("idx", "block", "type"))).alias("calls"))

    def each(row):
        page, found = cut_page(row.html)
        found = [els for els, told in found if _told(told)]
        for call in row.calls:
            if call["idx"] < len(found):
                frames = call["block"] == "media" or call["type"] in ("video", "embed")
                controls = call["block"] == "controls" or bool(re.search(CONTROL_TYPES, call["type"] or ""))
                body = "".join(cleaned(page, e, row.url or "", frames, controls) for e in found[call["idx"]])
                yield row.page_id, call["idx"], call["block"], call["type"], body

    return over_pages(pages.select("page_id", "url", "html").join(told, "page_id"), each, "page_id long, idx int, block string, type string, html string")
