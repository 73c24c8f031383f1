"""Readable text of HTML, and the main content of whole pages."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# How elements shape text.
BLOCK = frozenset("address article aside blockquote div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header li main nav ol p pre section table tr ul".split())
SKIPPED = frozenset("script style template noscript head title iframe object embed".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a start tag of the key ends, up to the nearest of the barriers.
ENDS = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "thead": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}
OPTIONAL_END = frozenset("p li dt dd td th tr tbody thead tfoot option html body head".split())

_SPACE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_RUNS = re.compile(f"[{_SPACE}]+|[^{_SPACE}]+")
NONE, BLANK, LINE = 0, 1, 2


class _Text(HTMLParser):
    """Walks a fragment and gathers its text; a separator is due until the next visible character."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.due = NONE
        self.stack: list[tuple[str, bool]] = []  # element, and whether it hides what it holds
        self.recovered = False
        self.pre_fresh = False

    def _gap(self, kind: int) -> None:
        self.due = max(self.due, kind)

    def _put(self, text: str) -> None:
        if self.out and self.due:
            self.out.append(" " if self.due == BLANK else "\n")
        self.due = NONE
        self.out.append(text)

    def _hidden(self) -> bool:
        return any(h for _, h in self.stack)

    def _close(self, at: int) -> None:
        while len(self.stack) > at:
            tag, hides = self.stack.pop()
            if not self._hidden():
                self._gap(BLANK if hides else LINE if tag in BLOCK else BLANK if tag in ("td", "th") else NONE)

    def _last(self, tags: set[str], barriers: set[str]) -> int:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in tags:
                return k
            if self.stack[k][0] in barriers:
                return -1
        return -1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.pre_fresh = False
        if tag in BLOCK and (k := self._last({"p"}, {"table", "td", "th", "button", "object"})) >= 0:
            self._close(k)
        if tag in ENDS and (k := self._last(*ENDS[tag])) >= 0:
            self._close(k)
        hides = tag in SKIPPED or any(name == "hidden" for name, _ in attrs)
        if not self._hidden():
            self._gap(BLANK if hides else LINE if tag in BLOCK or tag in ("br", "hr") else BLANK if tag in ("img", "td", "th") else NONE)
        if tag not in VOID:
            self.stack.append((tag, hides))
            self.pre_fresh = tag in ("pre", "textarea")

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.recovered = True

    def handle_endtag(self, tag: str) -> None:
        self.pre_fresh = False
        k = self._last({tag}, {"table"} - {tag})
        if k < 0:
            self.recovered = True
            if tag in ("p", "br") and not self._hidden():
                self._gap(LINE)
            return
        if any(t not in OPTIONAL_END for t, _ in self.stack[k + 1 :]):
            self.recovered = True
        self._close(k)

    def handle_data(self, data: str) -> None:
        if self.pre_fresh:
            data, self.pre_fresh = re.sub(r"^\r?\n", "", data, count=1), False
        if not data or self._hidden():
            return
        if any(t in ("pre", "textarea") for t, _ in self.stack):
            self._put(re.sub(r"\r\n?", "\n", data))
            return
        for piece in _RUNS.findall(data):
            self._gap(BLANK) if piece[0] in _SPACE else self._put(piece)

    def text(self) -> tuple[str, bool]:
        self.close()
        if any(t not in OPTIONAL_END for t, _ in self.stack):
            self.recovered = True
        text = "".join(self.out)
        return ("" if all(c in _SPACE for c in text) else text), self.recovered


def fragment_text(html: str) -> tuple[str, bool]:
    """Text of a fragment, and whether the markup had to be repaired (a best effort, not a full HTML5 parser's report)."""
    walker = _Text()
    walker.feed(html)
    return walker.text()


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("recovered", T.BooleanType())]))
def html_text(html: pd.Series) -> pd.DataFrame:
    """struct(text, recovered) of an HTML fragment; null gives empty text."""
    rows = [fragment_text(h or "") for h in html]
    return pd.DataFrame({"text": [r[0] for r in rows], "recovered": [r[1] for r in rows]})


# Where pages keep their main content, in order of preference, and what is cut from it.
MAIN = ("main", "[role=main]", "article", ".boostbook", ".refentry", ".chapter", "#content", ".contents", ".document", "body")
CUT = frozenset("script style nav aside footer noscript template iframe object form".split())


class _Tree(HTMLParser):
    """A light tree: (tag, attributes, start, end of the source) of each element."""

    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.source = source
        self.lines = [0]
        for m in re.finditer("\n", source):
            self.lines.append(m.end())
        self.nodes: list[dict] = []
        self.open: list[int] = []
        self.feed(source)
        self.close()
        for k in self.open:
            self.nodes[k]["end"] = self.nodes[k]["inner"] = len(source)

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag: str, attrs: list) -> None:
        at = self._at()
        self.nodes.append({"tag": tag, "attrs": {k: v or "" for k, v in attrs}, "start": at, "body": at + len(self.get_starttag_text() or ""), "end": at + len(self.get_starttag_text() or ""), "inner": at})
        if tag not in VOID:
            self.open.append(len(self.nodes) - 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[k]]["tag"] == tag:
                at = self._at()
                close = self.source.find(">", at)
                for j in self.open[k:]:
                    self.nodes[j]["inner"], self.nodes[j]["end"] = at, at
                self.nodes[self.open[k]]["end"] = close + 1 if close >= 0 else len(self.source)
                del self.open[k:]
                return

    def pick(self, selector: str) -> list[dict]:
        if selector[0] == ".":
            return [n for n in self.nodes if selector[1:] in n["attrs"].get("class", "").split()]
        if selector[0] == "#":
            return [n for n in self.nodes if n["attrs"].get("id") == selector[1:]]
        if selector[0] == "[":
            name, value = selector[1:-1].split("=")
            return [n for n in self.nodes if n["attrs"].get(name) == value]
        return [n for n in self.nodes if n["tag"] == selector]


def page_content(html: str) -> tuple[str, str, str]:
    """(title, url, text) of a page: the first selector with exactly one match, without navigation and scripts."""
    tree = _Tree(html)
    cut = [n for n in tree.nodes if n["tag"] in CUT or any("nav" in c for c in n["attrs"].get("class", "").split())]
    inside = lambda n, m: m["start"] <= n["start"] and n["end"] <= m["end"] and n is not m
    main = None
    for selector in MAIN:
        found = [n for n in tree.pick(selector) if not any(inside(n, c) or n is c for c in cut)]
        if len(found) == 1:
            main = found[0]
            break
    a, b = (main["body"], main["inner"]) if main else (0, len(html))
    parts, at = [], a
    for c in sorted((c for c in cut if a <= c["start"] and c["end"] <= b), key=lambda c: c["start"]):
        if c["start"] >= at:
            parts.append(html[at : c["start"]] + " ")
            at = c["end"]
    parts.append(html[at:b])
    text = fragment_text("".join(parts))[0]
    words = lambda n: fragment_text(html[n["body"] : n["inner"]])[0]
    title = next((w for n in tree.pick("h1") if (w := words(n))), "") or next((w for n in tree.pick("title") if (w := words(n))), "")
    url = next((n["attrs"].get("href", "") for n in tree.pick("link") if n["attrs"].get("rel") == "canonical"), "") or next((n["attrs"].get("content", "") for n in tree.pick("meta") if n["attrs"].get("property") == "og:url"), "")
    return title, url, text


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("title", "url", "text")]))
def main_content(html: pd.Series) -> pd.DataFrame:
    """struct(title, url, text) of a page."""
    rows = [page_content(h or "") for h in html]
    return pd.DataFrame({"title": [r[0] for r in rows], "url": [r[1] for r in rows], "text": [r[2] for r in rows]})
