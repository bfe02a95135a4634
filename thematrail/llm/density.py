"""Main text of web pages by composite text density.

A page is read into a tree without the elements that are never main text. Class names and ids are weak evidence: a hinted
element stays if it holds an article, main or h1 or a large share of the page's unlinked characters. Every node has the characters and tags under it
and those under links; its density is characters per tag, adjusted by the share of links. Densities of
children are summed up, the container with the largest sum is the core of the page, also inside an article, and the smallest density
on its path to the body is the threshold that tells which neighbours of the path belong to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style template textarea title xmp".split())
DROPPED = RAW | frozenset(
    "annotation annotation-xml audio button canvas head input label legend map object select svg video".split()
)
#: Dropped elements that end a block; the others stand inside a line.
DROPPED_BLOCKS = frozenset("head legend title".split())
#: Parts of a formula; they are read as the text of their math element.
FORMULA = frozenset(
    "maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle "
    "msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
#: Elements beside the main text by their meaning, and roles that say the same.
ASIDES = frozenset("aside dialog footer header menu nav".split())
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption dialog menu option search".split()
)
#: Elements that are parts of a text and never its container.
PARTS = frozenset(
    "a abbr acronym address b bdi bdo big br caption cite code col data del dfn dt em figcaption font h1 h2 h3 h4 h5 h6 hr i img ins kbd mark math p pre q rp rt "
    "ruby s samp small span strike strong sub summary sup time tt u var wbr".split()
)
CLOSES_P = BLOCKS - frozenset("br body html td th tr tbody thead tfoot caption option legend li dd dt summary figcaption".split())
#: Opening one of these ends an open one of the same list, up to the element that may hold them.
SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
    "tbody": (("tbody", "thead", "tfoot", "tr"), ("table",)), "thead": (("tbody", "thead", "tfoot", "tr"), ("table",)), "tfoot": (("tbody", "thead", "tfoot", "tr"), ("table",)),
}
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split())
#: Class names and ids that hint at boilerplate, as whole names (digits at the end aside).
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header "
    "masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup promo related replies respond share sharing sidebar "
    "skip social sponsor sponsored subscribe toolbar widget "
    "comment-form comment-list comments-area cookie-banner cookie-bar cookie-consent cookie-notice main-menu main-nav main-navigation nav-menu "
    "related-articles related-posts share-buttons site-footer site-header site-nav site-navigation skip-link social-links social-share".split()
)
#: Reader comments and adverts have many compound names: every part is in one of these lists and at least one in the first.
ADDED = frozenset("ad ads advert adverts advertisement advertisements comment comments disqus newsletter promo sponsor sponsored".split())
PLACES = frozenset(
    "area banner block bottom box container content form inner item items label list outer panel post posts reader readers section sections side slot "
    "text thread threads top unit user wrap wrapper".split()
)
#: Shares of the unlinked characters of a page from which a hint counts for nothing: without and with an article elsewhere.
LARGE, LARGE_BESIDE_ARTICLE = 0.5, 0.9
#: Share that all hinted elements together may take away; beyond it only those made of links go.
TOGETHER = 0.75
#: Inside an article a sparse element is left out if more than one in so many of its characters is linked.
UNLINKED = 10
#: Elements that make a sparse neighbour of the path a part of a text where no article or main says where the text ends.
PARAGRAPHS = frozenset("blockquote dd dt h1 h2 h3 h4 h5 h6 li p pre".split())
_COPYRIGHT = re.compile(r"\s*(?:copyright\b|©|\(c\))", re.I)

# quotes count after an equals sign only; one that is never closed is no quote, so the tag ends at the next '>'
_ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+))?+)?+""")
_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)"""
    r"""((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+)*+)(?:>|\Z)""", re.S
)
_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}


_KEPT, _ASIDE, _HINTED, _DROPPED = range(4)


@lru_cache(maxsize=1 << 14)
def _hinted(name: str) -> bool:
    """Whether a class name or id hints at boilerplate."""
    name = name.rstrip("0123456789")
    if name in HINTS:
        return True
    parts = [x for x in re.split("[-_]+", name) if x and not x.isdigit()]
    return any(x in ADDED for x in parts) and all(x in ADDED or x in PLACES for x in parts)


def _kind(tag: str, attributes: str, inside_article: bool, inside: bool) -> int:
    """The kind of an element; an article inside another may be a reader's comment, so its names count."""
    if tag in DROPPED:
        return _DROPPED
    if tag in ("html", "body", "main", "h1") or tag == "article" and not inside_article:
        return _KEPT
    kind = _HINTED if tag == "form" else _ASIDE if tag in ASIDES and not (tag == "header" and inside) else _KEPT
    if kind == _ASIDE or not attributes or tag == "header":
        return kind
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        value = (a or b or c).lower()
        if (name := name.lower()) == "role":
            kind = max(kind, _ASIDE if value in ROLES else _HINTED if value == "form" else _KEPT)
        elif name in ("class", "id") and any(map(_hinted, value.split())):
            kind = _HINTED
    return kind


class _Page:
    """The tree as columns, nodes in page order; node 0 is the root and stands for the body too."""

    def __init__(self, html: str):
        self.tag, self.parent, self.kind, self.pieces = ["body"], [-1], [_KEPT], []  # pieces: (node, text or None for the start or end of a block)
        stack, open_tags, position, dropping = [0], ["body"], 0, 0
        opened: dict[str, int] = {}  # how many of each are open
        inside = 0  # articles and mains that are open
        while position < len(html):
            found = _TAG.search(html, position)
            text = html[position : found.start() if found else len(html)]
            if text and not dropping:
                self.pieces.append((stack[-1], unescape(text)))
            if not found:
                break
            position = found.end()
            closing, tag, attributes = found.groups()
            if tag is None:
                continue
            tag = tag.lower()
            if tag in FORMULA and opened.get("math"):
                continue
            if closing:
                if opened.get(tag) and tag not in VOID:
                    while True:
                        last = open_tags.pop()
                        opened[last] -= 1
                        node = stack.pop()
                        inside -= last in ("article", "main")
                        dropping -= node < 0
                        if node >= 0 and last in BLOCKS and not dropping:
                            self.pieces.append((node, None))
                        if last == tag:
                            break
                continue
            if tag in RAW:
                end = _END[tag].search(html, position)
                position = end.start() if end else len(html)
            if tag in ("html", "body", "head") and tag != "head":
                continue
            ends, until = SIBLINGS.get(tag, (("p",), ("button", "table", "td", "th", "caption", "object")) if tag in CLOSES_P else ((), ()))
            if any(opened.get(x) for x in ends):
                deep = len(open_tags) - 1
                target = 0
                while deep > 0 and open_tags[deep] not in until:
                    target = deep if open_tags[deep] in ends else target
                    if tag in CLOSES_P and target:
                        break
                    deep -= 1
                while target and len(open_tags) > target:
                    last, node = open_tags.pop(), stack.pop()
                    opened[last] -= 1
                    inside -= last in ("article", "main")
                    dropping -= node < 0
                    if node >= 0 and last in BLOCKS and not dropping:
                        self.pieces.append((node, None))
            kind = _DROPPED if dropping else _kind(tag, attributes, opened.get("article", 0) > 0, inside > 0)
            if kind == _DROPPED:
                if not dropping and tag in DROPPED_BLOCKS:
                    self.pieces.append((stack[-1], None))
                if tag not in VOID:
                    open_tags.append(tag)
                    opened[tag] = opened.get(tag, 0) + 1
                    stack.append(-1)
                    dropping += 1
                    inside += tag in ("article", "main")
                continue
            self.tag.append(tag)
            self.parent.append(stack[-1])
            self.kind.append(kind)
            if tag in BLOCKS:
                self.pieces.append((len(self.tag) - 1, None))
            if tag not in VOID:
                open_tags.append(tag)
                opened[tag] = opened.get(tag, 0) + 1
                stack.append(len(self.tag) - 1)
                inside += tag in ("article", "main")
        self._cut_asides()
        self._cut_hinted()

    def _measured(self) -> tuple[list[bool], list[int], list[int]]:
        """Of every node: whether it lies in a link, its own characters, and those in links."""
        n = len(self.tag)
        chars, links, linked = [0] * n, [0] * n, [False] * n
        for i in range(1, n):
            linked[i] = linked[self.parent[i]] or self.tag[i] in ("a", "button", "select")
        for node, text in self.pieces:
            if text:
                size = sum(map(len, text.split()))
                chars[node] += size
                links[node] += size * linked[node]
        return linked, chars, links

    def _holding(self, *tags: str) -> list[bool]:
        """Whether a node is or holds one of these elements; articles inside an article do not count."""
        held, inside = [t in tags for t in self.tag], [False] * len(self.tag)
        for i in range(1, len(held)):
            inside[i] = inside[self.parent[i]] or self.tag[self.parent[i]] == "article"
            held[i] = held[i] and not (inside[i] and self.tag[i] == "article")
        for i in range(len(held) - 1, 0, -1):
            held[self.parent[i]] |= held[i]
        return held

    def _cut_asides(self) -> None:
        """Cut the elements whose meaning is not main text, unless they hold an article, main or h1."""
        if _ASIDE in self.kind:
            held = self._holding("article", "main", "h1")
            self._cut([k == _ASIDE and not h for k, h in zip(self.kind, held)])

    def _cut_hinted(self) -> None:
        """Cut elements with a hint, unless they hold an article, main or h1 or a large share of the unlinked characters.

        Hints that together would take a large share away are trusted for elements made of links only.
        """
        if _HINTED not in self.kind:
            return
        n = len(self.tag)
        _, chars, links = self._measured()
        held, articles = self._holding("article", "main", "h1"), [0] * n
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            articles[i] += chars[i] if self.tag[i] in ("article", "main") else 0
            chars[up] += chars[i]
            links[up] += links[i]
            articles[up] += articles[i]
        free = [c - k for c, k in zip(chars, links)]
        large = (LARGE * free[0], LARGE_BESIDE_ARTICLE * free[0])
        hinted, outer, beside = [False] * n, [False] * n, [articles[0] > 0] * n
        taken = [0, 0]  # unlinked characters of outermost hinted elements, by whether an article is elsewhere
        for i in range(1, n):
            up = self.parent[i]
            beside[i] = beside[up] and self.tag[i] not in ("article", "main")
            hinted[i] = self.kind[i] == _HINTED and not held[i] and free[i] <= large[beside[i]]
            outer[i] = outer[up] or hinted[i]
            taken[beside[i]] += free[i] * (hinted[i] and not outer[up])
        trusted = [taken[0] <= TOGETHER * free[0], taken[1] <= large[1]]
        self._cut([h and (trusted[b] or 2 * k > c) for h, b, k, c in zip(hinted, beside, links, chars)])

    def _cut(self, cut: list[bool]) -> None:
        """Take nodes out with all they hold; a block ends where a block was."""
        place, size = [0] * len(cut), 1
        for i in range(1, len(cut)):
            up = place[self.parent[i]]
            if cut[i] or up < 0:
                place[i] = up if up < 0 else ~up
            else:
                place[i], size = size, size + 1
        stay = [i for i, p in enumerate(place) if p >= 0]
        ends = [False] * len(cut)  # cut nodes that are or hold a block
        for i in range(len(cut) - 1, 0, -1):
            ends[i] = ends[i] or self.tag[i] in BLOCKS
            ends[self.parent[i]] |= ends[i]
        self.pieces = [
            (place[node], text) if place[node] >= 0 else (~place[node], None)
            for node, text in self.pieces if place[node] >= 0 or ends[node]
        ]
        self.tag, self.kind = [self.tag[i] for i in stay], [self.kind[i] for i in stay]
        self.parent = [place[self.parent[i]] if i else -1 for i in stay]

    def densities(self) -> list[float]:
        n = len(self.tag)
        tags, link_tags = [0] * n, [0] * n
        linked, chars, links = self._measured()
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            chars[up] += chars[i]
            links[up] += links[i]
            tags[up] += tags[i] + 1
            link_tags[up] += link_tags[i] + linked[i]
        body = links[0] / max(chars[0], 1)
        out = []
        for t, lc, tg, lt in zip(chars, links, tags, link_tags):
            if not t:
                out.append(0.0)
                continue
            lc1, tg, lt = max(lc, 1), max(tg, 1), max(lt, 1)
            base = log(t / max(t - lc, 1) * lc1 + body * t + e)
            out.append(t / tg * max(log(max(t / lc1 * tg / lt, 1.0)) / log(base), 0.0))
        return out

    def core(self) -> set[int]:
        """The roots of the main text: the container with the largest sum of densities, and what is dense beside its path.

        A main or article under that container with most of its unlinked characters is searched instead, but nothing inside an
        article. Elements beside the path count if they are as dense as the sparsest node on it. Density grows with the size of a
        node, so short parts of a text would fall below: sparse elements count too if almost nothing in them is linked, inside the
        innermost article or main around the core any, where there is neither those with a paragraph, list item or heading that does not
        begin with a copyright mark. Outside that article or main only further articles count whose heading is no link. If no
        h1 is found so, the last one before the core that is no link and in no boilerplate but a header is added as its title.
        """
        n, density = len(self.tag), self.densities()
        linked, chars, links = self._measured()
        sums, end = [0.0] * n, list(range(1, n + 1))
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            sums[up] += density[i]
            chars[up] += chars[i]
            links[up] += links[i]
            end[up] = max(end[up], end[i])
        free = [c - k for c, k in zip(chars, links)]
        holders = [i for i in range(n) if self.tag[i] not in PARTS]
        articles = [i for i in holders if self.tag[i] in ("article", "main")]

        def path_of(node: int) -> list[int]:
            path = [node]
            while path[-1]:
                path.append(self.parent[path[-1]])
            return path

        path = path_of(max(holders, key=sums.__getitem__))
        while not any(self.tag[i] == "article" for i in path):
            best = path[0]
            inner = next((i for i in articles if best < i < end[best] and 2 * free[i] > free[best]), None)
            if inner is None:
                break
            path = path_of(max((i for i in holders if inner <= i < end[inner]), key=sums.__getitem__))
        best, on_path = path[0], set(path)
        scope = next((i for i in path if self.tag[i] in ("article", "main")), 0)
        threshold = min(density[i] for i in path)
        roots = {best}
        heads = [t in ("h1", "h2", "h3", "h4", "h5", "h6") for t in self.tag]
        first = {}  # first text of a node
        for node, text in self.pieces:
            if text and not text.isspace():
                first.setdefault(node, text)
        for i in range(1, n):
            up = self.parent[i]
            if up == best or up not in on_path or i in on_path:
                continue
            dense, sparse = density[i] >= threshold > 0, 0 < chars[i] >= UNLINKED * links[i]
            under = range(i, end[i])
            if up < scope:
                teaser = any(heads[j] and any(linked[k] for k in range(j, end[j])) for j in under)
                sparse = sparse and self.tag[i] == "article" and not teaser
                dense = dense and self.tag[i] == "article"
            elif not scope and sparse:
                begin = next((first[j] for j in under if j in first), "")
                sparse = any(self.tag[j] in PARAGRAPHS for j in under) and not _COPYRIGHT.match(begin)
            if dense or sparse:
                roots.add(i)
        if not any(self.tag[i] == "h1" for r in roots for i in range(r, end[r])):
            titles = [i for i in range(1, best) if self.tag[i] == "h1" and not any(linked[j] for j in range(i, end[i]))]
            beside = lambda i: any(self.kind[j] and self.tag[j] != "header" for j in path_of(i))
            roots |= set([i for i in titles if not beside(i)][-1:])
        return roots

    def text(self) -> str:
        roots = self.core()
        kept = [i in roots for i in range(len(self.tag))]
        if 0 in roots:
            kept = [True] * len(kept)
        else:
            for i in range(1, len(kept)):
                kept[i] = kept[i] or kept[self.parent[i]]
            for i in {self.parent[r] for r in roots} - roots:
                kept[i] = False
        blocks, block = [], []
        for node, text in [*self.pieces, (0, None)]:
            if text is None or not kept[node]:
                if block and (line := " ".join("".join(block).split())):
                    blocks.append(line)
                block = []
            else:
                block.append(text)
        return "\n".join(blocks)


def main_text(html: str | None) -> str:
    """Main text of one page: its blocks in page order, one a line."""
    return _Page(html).text() if html else ""


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            texts = [main_text(h.as_py()) for h in part.column("html")]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract_text(pages: DataFrame, page_id: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """(page_id, url, text, n_chars) of every page: main text as blocks joined by line feeds.

    Character references are decoded, white space inside a block is one space, a line break ends a block. Null and
    empty pages, and pages of boilerplate alone, have the empty text. Broken markup is read as browsers do for
    open paragraphs, list items and cells; an element that is never closed ends with the page. Rows stay where they
    are and are returned each, repeated ones too; other columns are left out.
    """
    wanted = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    kind = dict(wanted.dtypes)["page_id"]
    found = wanted.mapInArrow(_extracted, f"page_id {kind}, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("bigint"))
