"""One page's elements in document order, as parallel lists: a subtree is a range of numbers, its text a range of places.

Nothing recurses and every sum over a subtree is a difference of two running sums, so a page of any depth costs time in
proportion to its size.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np

# Groups of tags.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIP = frozenset("script style noscript template link meta head".split())
BREAKS = frozenset("p div li tr h1 h2 h3 h4 h5 h6 br section article".split())
LANDMARKS = frozenset("header nav main article section aside footer form dialog".split())
ROLES = frozenset("navigation main banner contentinfo complementary search form dialog region".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTROLS = frozenset("input textarea select button".split())
PICTURES = frozenset("img svg video canvas".split())
# Tags that end an open element without an end tag of its own, and where the search for it stops.
BLOCK = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul li dt dd tr td th tbody thead tfoot".split())
IN_HEAD = frozenset("title meta link script style base noscript template".split())
ENDS = {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "tbody": ("tr", "td", "th", "tbody", "thead", "p"), "option": ("option",)}
SCOPES = frozenset("table ul ol dl body template".split())
SPACE = np.array([*range(9, 14), 32, 160, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF], np.uint32)

_COUNTED = {
    "links": lambda t, a: t == "a" and "href" in a, "headings": lambda t, a: t in HEADINGS, "list_items": lambda t, a: t == "li", "table_rows": lambda t, a: t == "tr",
    "controls": lambda t, a: t in CONTROLS, "paragraphs": lambda t, a: t == "p", "h1": lambda t, a: t == "h1", "tables": lambda t, a: t == "table", "th": lambda t, a: t in ("th", "thead"),
    "tall": lambda t, a: t in ("iframe", "video") or (t in PICTURES and len(h := re.match(r"\d*", a.get("height", ""))[0]) > 0 and int(h) >= 64),
    "landmarks": lambda t, a: t in LANDMARKS - {"form", "dialog"}, "solid": lambda t, a: t in ("h1", "h2", "h3", "table", "ul", "ol") or t in CONTROLS,
}


def box(value: str | None) -> tuple[float, ...] | None:
    """left, top, width, height of a geometry attribute."""
    numbers = re.findall(r"-?\d+(?:\.\d+)?", value or "")
    return tuple(map(float, numbers)) if len(numbers) == 4 else None


class Page(HTMLParser):
    """``tag``, ``attrs``, ``parent``, ``parts`` (children and texts), ``end`` of the subtree and more, by element number; 0 is html."""

    def __init__(self, source: str | None):
        super().__init__(convert_charrefs=True)
        self.tag, self.attrs, self.parent, self.parts, self.end = ["html"], [{}], [-1], [[]], [0]
        self.before, self.mute, self.shadow, self.direct = [-1], [False], [False], [0]
        self._begin, self._stop, self._raw, self._size = [0], [0], [], 0
        self._stack, self._open, self.title, self._body = [0], {}, "", None
        self.feed(source or "")
        self.close()
        while self._stack:
            self._leave()
        self._measure()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "html":
            self.attrs[0] |= {k: v or "" for k, v in attrs}
            return
        if self._open.get("head") and tag not in IN_HEAD:
            self._pop_to("head")
        ends = ENDS.get(tag, ("p",) if tag in BLOCK else ())
        if any(self._open.get(t) for t in ends):
            for k in range(len(self._stack) - 1, 0, -1):
                own = self.tag[self._stack[k]]
                if own in SCOPES and not (own == "table" and tag in ("tr", "tbody")):
                    break
                if own in ends:
                    del_to = k
                    while len(self._stack) > del_to:
                        self._leave()
        up, i = self._stack[-1], len(self.tag)
        own = {k: v or "" for k, v in attrs}
        shadow = tag == "template" and "shadowrootmode" in own
        last = next((p for p in reversed(self.parts[up]) if isinstance(p, int)), -1)
        for lst, v in ((self.tag, tag), (self.attrs, own), (self.parent, up), (self.parts, []), (self.end, 0), (self.before, last), (self.direct, 0), (self._begin, self._size), (self._stop, 0)):
            lst.append(v)
        self.mute.append(self.mute[up] or (tag in SKIP and not shadow))
        self.shadow.append(self.shadow[up] or shadow)
        self.parts[up].append(i)
        self._stack.append(i)
        self._open[tag] = self._open.get(tag, 0) + 1
        if tag in VOID:
            self._leave()

    def _leave(self) -> None:
        i = self._stack.pop()
        if self.tag[i] in BREAKS and not self.mute[i]:
            self._raw.append("\n")
            self._size += 1
        self._stop[i], self.end[i] = self._size, len(self.tag)
        if i:
            self._open[self.tag[i]] -= 1

    def _pop_to(self, tag: str) -> None:
        while self._stack:
            i = self._stack[-1]
            self._leave()
            if self.tag[i] == tag:
                break

    def handle_endtag(self, tag: str) -> None:
        if tag not in ("html", "body") and self._open.get(tag):
            self._pop_to(tag)

    def handle_data(self, data: str) -> None:
        i = self._stack[-1]
        if self.tag[i] == "title" and not self.title:
            self.title = " ".join(data.split())
        self.parts[i].append(data)
        if not self.mute[i] and self.tag[i] != "title":
            self.direct[i] += len(data.strip())
            self._raw.append(data)
            self._size += len(data)

    def _measure(self) -> None:
        raw = "".join(self._raw)
        codes = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32)
        blank = (codes == 32) | (codes == 9)
        keep = np.ones(len(codes), bool)
        keep[1:] = ~(blank[1:] & blank[:-1])
        for m in re.finditer(r"\n\s*\n", raw):
            keep[m.start() + 1 : m.end()] = False
        codes = np.where(codes == 9, np.uint32(32), codes)[keep]
        place = np.concatenate(([0], np.cumsum(keep)))
        self._text = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        self._solid = np.flatnonzero(~np.isin(codes, SPACE))
        lo = np.searchsorted(self._solid, place[self._begin]) if len(raw) else np.zeros(len(self.tag), int)
        hi = np.searchsorted(self._solid, place[self._stop]) if len(raw) else np.zeros(len(self.tag), int)
        full = hi > lo
        solid = self._solid if len(self._solid) else np.zeros(1, int)
        self.first = np.where(full, solid[np.minimum(lo, len(solid) - 1)], 0)
        self.last = np.where(full, solid[np.minimum(np.maximum(hi - 1, 0), len(solid) - 1)] + 1, 0)
        self.length = (self.last - self.first).tolist()
        at = range(len(self.tag))
        plain = [not s for s in self.shadow]
        self._sums = {k: np.concatenate(([0], np.cumsum([plain[i] and f(self.tag[i], self.attrs[i]) for i in at]))) for k, f in _COUNTED.items()}
        anchor = [len(raw[self._begin[i] : self._stop[i]].strip()) if plain[i] and self.tag[i] == "a" and "href" in self.attrs[i] else 0 for i in at]
        self._anchor_text = np.concatenate(([0], np.cumsum(anchor)))
        self.box = [box(a.get("data-mx-r")) for a in self.attrs]
        self.seen = [False] * len(self.tag)
        for i in reversed(at):
            a, b = self.attrs[i], self.box[i]
            style = a.get("style", "").replace(" ", "").lower() if "style" in a else ""
            hidden = self.tag[i] in SKIP or "hidden" in a or "data-mx-h" in a or "display:none" in style or "visibility:hidden" in style or re.search(r"opacity:0(?![.\d])", style)
            self.seen[i] = not hidden and (b is None or (b[2] > 4 and b[3] > 4) or any(self.seen[k] for k in self.children(i)))

    def children(self, i: int) -> list[int]:
        return [p for p in self.parts[i] if isinstance(p, int) and not (self.shadow[p] and self.tag[p] == "template")]

    def kids(self, i: int) -> list[int]:
        """Visible child elements."""
        return [k for k in self.children(i) if self.seen[k]]

    def text(self, i: int) -> str:
        return self._text[self.first[i] : self.last[i]]

    def count(self, kind: str, i: int) -> int:
        """Elements of a kind below i."""
        own = self._sums[kind]
        return int(own[self.end[i]] - own[i + 1])

    def is_a(self, kind: str, i: int) -> bool:
        return bool(self._sums[kind][i + 1] - self._sums[kind][i])

    def link_text(self, i: int) -> int:
        return int(self._anchor_text[self.end[i]] - self._anchor_text[i + 1])

    def below(self, i: int, *tags: str) -> list[int]:
        return [k for k in range(i + 1, self.end[i]) if self.tag[k] in tags and not self.shadow[k]]

    def body(self) -> int:
        if self._body is None:
            self._body = self.tag.index("body") if "body" in self.tag else 0
        return self._body

    def signature(self, i: int) -> str:
        """Tag and first two classes."""
        return self.tag[i] + "." + ".".join(self.attrs[i].get("class", "").split()[:2])

    def up(self, i: int) -> list[int]:
        """The elements around i below the body, from the inside out."""
        out, body = [], self.body()
        while i > 0 and i != body:
            out.append(i)
            i = self.parent[i]
        return out
