"""Main text of web pages by composite text density.

A page is parsed into a tree.  Every node gets its text length per tag, adjusted for links (text in links counts against it,
scaled by the share of links in the whole body).  The sum of a node's child densities tells where many dense nodes stand side
by side: the node with the largest sum is the seed of the article, and the smallest density between it and the body is the
threshold; further blocks outside the seed whose own density reaches the threshold belong to the article as well.  Sums and densities
grow with the length of a block, so short parts of the article are kept by where they stand: a seed inside an article or main
element is raised to the nearest one, and text blocks (headings, paragraphs, lists and what holds such) beside the way up to the
main element, or to the body on pages with neither, are kept if at most a third of their text is in links.
What a page marks as something else (menus, headers and footers of the page, sidebars, notices, adverts,
forms, scripts, reader comments) is taken out before.

Null and empty pages have an empty text.  Text without any tag is one block.
"""

from __future__ import annotations

import html
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stopwise.llm.store import map_rows

# Element names of the HTML standard by what they do here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
DROPPED = frozenset("head script style noscript template svg math iframe object embed canvas audio video nav aside footer form button "
                    "select textarea input dialog menu title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
                   "strike strong sub sup time tt u var wbr".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
                   "h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
            "option": {"option"}, "tbody": {"thead", "tbody", "tfoot", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
SCOPES = frozenset("ul ol dl table td th select body article section div main".split())
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|promotion|popup|modal|overlay|cookie|"
    r"cookies|consent|gdpr|notice|notices|alert|sidebar|side|rail|widget|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|footer|"
    r"masthead|toolbar|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|comment|comments|commentlist|disqus|"
    r"respond|replies|discussion|pagination|pager|skip|hidden)(?:$|[\s_-]|\d)", re.I)
TEXTUAL = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre ul ol dl table figure".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Page:
    """Nodes in page order: parent, tag, own pieces of text, and what is summed up over the subtree."""

    def __init__(self, text: str):
        self.parent, self.tag, self.dropped, self.end = [-1], ["#page"], [False], [0]
        self.pieces: list[tuple[int, str]] = []  # node and text, in page order; a mark of a block edge has text None
        self._parse(text)
        n = len(self.tag)
        self.chars, self.tags, self.link_chars, self.link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = in_link[self.parent[i]] or self.tag[i] == "a"
        for node, s in self.pieces:
            if s is not None:
                size = len("".join(s.split()))
                self.chars[node] += size
                self.link_chars[node] += size * in_link[node]
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            if not self.dropped[i]:
                self.chars[up] += self.chars[i]
                self.link_chars[up] += self.link_chars[i]
                self.tags[up] += self.tags[i] + 1
                self.link_tags[up] += self.link_tags[i] + (self.tag[i] == "a")

    def _parse(self, text: str) -> None:
        stack, at = [0], 0
        while at < len(text):
            m = TOKEN.search(text, at)
            self._text(stack[-1], text[at:m.start() if m else len(text)])
            if not m:
                break
            at = m.end()
            name = (m[2] or "").lower()
            if not name:
                if m[0].startswith("<![CDATA["):
                    self._text(stack[-1], m[0][9:-3])
            elif m[1]:
                self._close(stack, name)
            else:
                self._implied(stack, name)
                node = self._open(stack[-1], name, m[3])
                if name in RAW:
                    stop = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(text, at)
                    self._text(node, text[at:stop.start() if stop else len(text)])
                    at = stop.end() if stop else len(text)
                elif name not in VOID:
                    stack.append(node)

    def _text(self, node: int, s: str) -> None:
        if s and not self.dropped[node]:
            self.pieces.append((node, html.unescape(s) if "&" in s else s))

    def _open(self, parent: int, name: str, attributes: str) -> int:
        node = len(self.tag)
        self.parent.append(parent)
        self.tag.append(name)
        self.dropped.append(self.dropped[parent] or self._foreign(parent, name, attributes))
        if name not in INLINE:
            self.pieces.append((node, None))
        return node

    def _foreign(self, parent: int, name: str, attributes: str) -> bool:
        """Whether an element is marked as something else than the article."""
        if name in DROPPED:
            return True
        if name == "header":
            while parent > 0:
                if self.tag[parent] in ("article", "main"):
                    return False
                parent = self.parent[parent]
            return True
        if not attributes.strip() or name in ("html", "body", "article", "main"):
            return False
        told = {a[0].lower(): a[1] or a[2] or a[3] for a in ATTRIBUTE.findall(attributes)}
        named = " ".join(told.get(k, "") for k in ("class", "id"))
        return bool(named and MARKED.search(named)) or told.get("role", "").lower() in ROLES or "hidden" in told \
            or told.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none", told.get("style", ""), re.I))

    def _close(self, stack: list[int], name: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if self.tag[stack[k]] == name:
                self._leave(stack, k)
                return
            if name in INLINE and self.tag[stack[k]] not in INLINE:
                return  # an inline end tag does not close blocks
        if name in ("p", "br"):
            self.pieces.append((stack[-1], None))

    def _leave(self, stack: list[int], k: int) -> None:
        if any(self.tag[node] not in INLINE for node in stack[k:]):
            self.pieces.append((self.parent[stack[k]], None))
        del stack[k:]

    def _implied(self, stack: list[int], name: str) -> None:
        """Close what a start tag ends by itself."""
        ended = {"p"} if name in ENDS_P else SIBLINGS.get(name, ())
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[k]]
            if tag in ended:
                self._leave(stack, k)
                if name in ENDS_P:
                    return
            elif tag in SCOPES:
                return

    def densities(self) -> list[float]:
        body = self.body()
        chars, links = self.chars[body] or 1, self.link_chars[body]
        out = []
        for c, t, lc, lt in zip(self.chars, self.tags, self.link_chars, self.link_tags):
            if not c:
                out.append(0.0)
                continue
            t, lc1, lt1 = t or 1, lc or 1, lt or 1
            base = math.log(c / max(c - lc, 1) * lc + links / chars * c + math.e)
            out.append(max(0.0, c / t * math.log(max(c / lc1 * t / lt1, 1e-9)) / base) if t > 1 or lc else c / t)
        return out

    def body(self) -> int:
        return next((i for i, t in enumerate(self.tag) if t == "body" and not self.dropped[i]), 0)

    def main(self) -> list[int]:
        """Roots of the chosen subtrees."""
        n, body = len(self.tag), self.body()
        density = self.densities()
        sums = [0.0] * n
        for i in range(1, n):
            if not self.dropped[i] and self.tag[i] not in INLINE:
                sums[self.parent[i]] += density[i]
        inside = [i for i in range(n) if not self.dropped[i] and self.chars[i] and (i >= body)]
        if not inside:
            return []
        best = max(inside, key=lambda i: (sums[i], -i))
        if sums[best] <= 0:
            return [body]
        threshold, at, path = density[best], best, [best]
        while at not in (body, -1, 0):
            at = self.parent[at]
            path.append(at)
            if at != 0:
                threshold = min(threshold, density[at])
        seed = next((i for i in path if self.tag[i] in ("article", "main")), best)
        whole = next((i for i in path if self.tag[i] == "main"), body if seed == best and self.tag[seed] != "article" else seed)
        ways = set(path[path.index(seed):])
        beside = set(path[path.index(seed) + 1:path.index(whole) + 1])
        textual = [t in TEXTUAL for t in self.tag]
        for i in range(n - 1, 0, -1):
            if textual[i] and not self.dropped[i] and self.chars[i]:
                textual[self.parent[i]] = True
        chosen, covered = [seed], [False] * n
        for i in range(n):
            up = self.parent[i]
            covered[i] = i == seed or (up >= 0 and covered[up])
        for i in inside:  # in page order: parents before what they hold
            if covered[i] or i in ways or self.tag[i] in INLINE:
                continue
            near = self.parent[i] in beside and textual[i] and 3 * self.link_chars[i] <= self.chars[i]
            if near or density[i] >= threshold:
                chosen.append(i)
        return chosen

    def text(self) -> str:
        roots = set(self.main())
        taken = [False] * len(self.tag)
        for i in range(len(self.tag)):
            taken[i] = not self.dropped[i] and (i in roots or (self.parent[i] >= 0 and taken[self.parent[i]]))
        blocks, now = [], []
        for node, s in self.pieces:
            if s is None:
                blocks.append("".join(now))
                now = []
            elif taken[node]:
                now.append(s)
            if s is None:
                continue
        blocks.append("".join(now))
        return "\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row."""
    def make():
        def step(r):
            text = Page(r["html"]).text() if r["html"] else ""
            return [(r["page_id"], r["url"], text, len(text))]

        return step

    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], *T.StructType.fromDDL("text string, n_chars long").fields])
    return map_rows(pages.select("page_id", "url", "html"), make, schema, 200)
