"""Main text of web pages by composite text density.

A page becomes a small DOM (raw text elements, void elements, implied ends of
paragraphs and list items, markup cut off at the end of input). What is
boilerplate by its element, role, class or id (menus, page headers, footers,
asides, forms, scripts, notices, adverts, reader comments) is pruned first. A
class or id prunes by itself only if the whole of it names boilerplate
(``comments``, ``related-posts``, ``site-footer-2``); one that merely holds
such a word (``related-work``, ``login-flow``) prunes what is mostly links, and
as the class of a box outside article and main also what is sparser than the
page and not most of it. Ids of headings and paragraphs are anchors, no names.
For every other node the composite text density is its characters per tag,
weighted down by the share of links; a node's density sum adds up its
children's densities. The subtree with the largest sum is the content; the
least density on its path from body is the threshold for the rest of the page:
a walk down from body keeps the subtree of largest sum of every node at or
above it, and of nodes below it goes into those that are not mostly links.
Without links the density grows with an element's size, so a node also counts
if it reaches the threshold with all counts scaled to the size of body: a short
section beside a long one. An element without inner blocks, or whose own text
reaches the threshold, is kept as a whole. Content inside an ``article`` or
``main`` element takes in the whole element.

Text: character references decoded, white space within a block one space,
blocks trimmed and joined in page order by one space.

Edge cases: null, empty or markup-only html gives the empty text. A page
without body or html element is read as if it had them. Equal sums: the outer,
then the earlier node.
"""

from __future__ import annotations

import bisect
import html as html_entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .columnar import columns, slices

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp script small span "
    "strike strong style sub sup time tt u var wbr "
    # formulas
    "math menclose mfrac mi mn mo mover mpadded mroot mrow ms msqrt mstyle msub msubsup msup mtext munder munderover "
    "semantics".split())
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("ul ol menu dl table select article section div body".split())
_DROP = frozenset(
    "script style noscript template head title nav footer aside form button select option textarea input iframe object "
    "embed applet svg annotation annotation-xml canvas audio video map dialog menu noembed noframes".split())
_DROP_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_DROP_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot banner banners "
    "comment comments commentlist consent cookie cookies copyright disclaimer disqus dropdown feedback footer "
    "footnav gdpr hidden login menu menus modal nav navbar navigation newsletter notice notices "
    "notification outbrain overlay pager pagination paywall popup promo promos promoted promotion recommended related "
    "replies reply respond sharebar share sharing sidebar sidebars signup skip social sponsor sponsored sponsors "
    "subscribe subscription taboola toolbar topbar trending".split())
_DROP_OUTSIDE = frozenset("header masthead".split())
_DROP_LINKED = frozenset("breadcrumb breadcrumbs".split())  # menus if they are mostly links
# words that go before and after a name without changing what the element is
_BEFORE = frozenset(
    "article blog bottom desktop div dfp entry fixed global google gpt is js left main mobile page post primary reader "
    "right secondary site sticky story top user visually".split())
_BEFORE_HEADER = _BEFORE - frozenset("article blog entry post story".split())  # the content's own header stays
_AFTER = frozenset(
    "articles container inner items links list outer posts section slot stories thread widget wrap wrapper".split())
_AFTER_CLASS = _AFTER | frozenset(
    "area bar block bottom box btn button buttons icons item left panel right row top unit zone".split())
_ANCHORS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
_KEEP, _IF_LINKS, _IF_THIN, _CUT = range(4)
_STATES = frozenset("no not without with has have is show hide hides".split())
_WHOLE = frozenset(("article", "main"))
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<([!?])[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)"
                  r"|<(/?)([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _boilerplate(tag: str, raw: str, inside_content: bool) -> int:
    """Whether an element goes: never, if mostly links, if mostly links or thin, always."""
    if tag in _DROP or (tag == "header" and not inside_content):
        return _CUT
    if not raw or raw.isspace():
        return _KEEP
    attrs = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(raw)}
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return _CUT
    if attrs.get("role", "").lower() in _DROP_ROLES:
        return _CUT
    style = attrs.get("style", "").replace(" ", "").lower()
    if "display:none" in style or "visibility:hidden" in style:
        return _CUT
    if tag in ("body", "html", "main"):
        return _KEEP
    names = [(name, True) for name in attrs.get("class", "").split()]
    if tag not in _ANCHORS:
        names += [(name, False) for name in attrs.get("id", "").split()]
    return max((_named(tag, name, is_class, inside_content) for name, is_class in names), default=_KEEP)


def _named(tag: str, name: str, is_class: bool, inside_content: bool) -> int:
    words = [w.lower() for w in _NAMES.findall(name)]
    if tag in _WHOLE and len(words) > 1:
        return _KEEP  # a state such as has-comments says nothing about the element itself
    hits = [w for w in words if w in _DROP_NAMES or w in _DROP_LINKED or (w in _DROP_OUTSIDE and not inside_content)]
    if not hits or words[0] in _STATES:
        return _KEEP
    core = [w for w in words if len(w) > 1 and not w.isdigit()]
    first = core.index(hits[0])
    before = _BEFORE if any(w in _DROP_NAMES for w in hits) else _BEFORE_HEADER
    after = _AFTER_CLASS if is_class else _AFTER
    if any(w in _DROP_LINKED for w in hits):
        return _IF_LINKS
    if all(w in before for w in core[:first]) and all(w in hits or w in after for w in core[first:]):
        return _CUT
    if not is_class or inside_content or tag == "section" or tag in _ANCHORS:
        return _IF_LINKS
    # overflow-hidden and post-header tell little about a box
    return _IF_THIN if any(w in _DROP_NAMES and w != "hidden" for w in hits) else _IF_LINKS


class _Page:
    """The pruned DOM in page order: node 0 is the root; a subtree is the nodes from ``i`` to ``last[i]``."""

    def __init__(self, source: str):
        self.tags, self.parents, self.last, self.cut = ["#root"], [-1], [0], [False]
        self.content = [False]  # inside article or main
        self.links = [False]
        self.suspects: dict[int, int] = {}
        self.texts: list[tuple[int, bool, str]] = []
        self.stack, self.broken = [0], True
        at, end = 0, len(source)
        find = _TAG.search
        while at < end:
            if (m := find(source, at)) is None:
                self._text(source[at:])
                break
            if m.start() > at:
                self._text(source[at:m.start()])
            at = m.end()
            name = m.group(3) or m.group(7)
            if not name:
                continue
            if m.group(3) and not m.group(5):  # input ended inside the tag
                break
            name = name.lower()
            if m.group(2) or m.group(6):
                self._close(name)
                continue
            self._open(name, m.group(4) or "")
            if name in _RAW:
                stop = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(source, at)
                at = stop.start() if stop else end
        while self.stack:
            self._pop()
        if self.suspects:
            self._judge()

    def _judge(self) -> None:
        """Prunes the elements whose names leave it to their links and density."""
        n = len(self.tags)

        def counts(judge) -> tuple[list[int], list[int]]:
            chars, tags, links = [0] * n, [0] * n, [0] * n
            for node, _, text in self.texts:
                size = len("".join(text.split()))
                chars[node] += size
                links[node] += size * self.links[node]
            for i in range(n - 1, 0, -1):
                if not self.cut[i] and not judge(i, chars[i], tags[i], links[i]):
                    p = self.parents[i]
                    chars[p] += chars[i]
                    tags[p] += tags[i] + 1
                    links[p] += links[i]
            return chars, tags

        body = next((i for i in range(n) if self.tags[i] == "body"), 0)
        chars, tags = counts(lambda *_: False)
        size, density = chars[body], chars[body] / max(1, tags[body])

        def goes(i: int, c: int, t: int, lc: int) -> bool:
            why = self.suspects.get(i, _KEEP)
            self.cut[i] = why and 2 * lc > c or why == _IF_THIN and 2 * c <= size and c < density * max(1, t)
            return self.cut[i]

        counts(goes)
        for i in range(1, n):
            self.cut[i] = self.cut[i] or self.cut[self.parents[i]]
        kept, pending = [], False
        for node, broken, text in self.texts:
            pending = pending or broken
            if not self.cut[node]:
                kept.append((node, pending, text))
                pending = False
        self.texts = kept

    def _text(self, text: str) -> None:
        node = self.stack[-1]
        if not self.cut[node]:
            self.texts.append((node, self.broken, html_entities.unescape(text)))
            self.broken = False

    def _open(self, name: str, raw: str) -> None:
        if name in ("html", "body") and name in (self.tags[i] for i in self.stack):
            return
        if name in _CLOSES_P and any(self.tags[i] == "p" for i in self.stack):
            self._close("p")
        if name in _SIBLINGS:
            for depth in range(len(self.stack) - 1, 0, -1):
                tag = self.tags[self.stack[depth]]
                if tag in _SIBLINGS[name]:
                    del_to = depth
                    while len(self.stack) > del_to:
                        self._pop()
                    if name != "tr":
                        break
                elif tag in _SCOPES:
                    break
        if name not in _INLINE:
            self.broken = True
        if name in _VOID:
            if name not in ("br", "wbr", "hr"):
                self._node(name, raw)
                self._pop()
            return
        self._node(name, raw)

    def _node(self, name: str, raw: str) -> None:
        parent, i = self.stack[-1], len(self.tags)
        self.tags.append(name)
        self.parents.append(parent)
        self.last.append(i)
        why = _CUT if self.cut[parent] else _boilerplate(name, raw, self.content[parent])
        self.cut.append(why == _CUT)
        if why in (_IF_LINKS, _IF_THIN):
            self.suspects[i] = why
        self.content.append(self.content[parent] or name in _WHOLE)
        self.links.append(self.links[parent] or name == "a")
        self.stack.append(i)

    def _close(self, name: str) -> None:
        if name not in _INLINE:
            self.broken = True
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.tags[self.stack[depth]] == name:
                while len(self.stack) > depth:
                    self._pop()
                return

    def _pop(self) -> None:
        i = self.stack.pop()
        self.last[i] = len(self.tags) - 1


def _densities(page: _Page) -> tuple[list[float], list[float], list[float], list[float], list[bool]]:
    """(composite text density, density sum, density at body's size, that of the own text, mostly links) of every node.

    Pruned nodes count for nothing. A node's own text is what it holds outside links and inner blocks, as one tag.
    """
    n = len(page.tags)
    chars, tags, link_chars, link_tags, own = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for node, _, text in page.texts:
        size = len("".join(text.split()))
        chars[node] += size
        if page.links[node]:
            link_chars[node] += size
        else:
            own[node] += size
    for i in range(n - 1, 0, -1):
        if page.cut[i]:
            continue
        p = page.parents[i]
        chars[p] += chars[i]
        tags[p] += tags[i] + 1
        link_chars[p] += link_chars[i]
        link_tags[p] += link_tags[i] + (page.tags[i] == "a")
        if page.tags[i] in _INLINE:
            own[p] += own[i]
    body = next((i for i in range(n) if page.tags[i] == "body"), 0)
    body_share = link_chars[body] / max(1, chars[body])

    def composite(c: float, t: float, lc: float, lt: float) -> float:
        base = math.log(c / max(1, c - lc) * lc + body_share * c + math.e)
        return c / t * math.log(c / max(1, lc) * (t / max(1, lt)) + 1) / math.log(base + 1)

    density, total, scaled, own_scaled = [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        if page.cut[i] or not chars[i]:
            continue
        counts = chars[i], max(1, tags[i]), link_chars[i], link_tags[i]
        density[i] = composite(*counts)
        scaled[i] = composite(*(k * max(1, chars[body]) / chars[i] for k in counts))
        if own[i]:
            own_scaled[i] = composite(chars[body], chars[body] / own[i], 0, 0)
        if i:
            total[page.parents[i]] += density[i]
    return density, total, scaled, own_scaled, [2 * lc > c for c, lc in zip(chars, link_chars)]


def _content(page: _Page) -> list[int]:
    """The content nodes in page order, none inside another."""
    density, total, scaled, own_scaled, linked = _densities(page)
    n = len(page.tags)
    body = next((i for i, tag in enumerate(page.tags) if tag == "body"), 0)
    # the node of largest sum in every subtree; of equal sums the outer, then the earlier node
    best, blocks = list(range(n)), [False] * n
    for i in range(n - 1, 0, -1):
        p = page.parents[i]
        if not page.cut[i]:
            best[p] = max(best[p], best[i], key=lambda k: (total[k], -k))
            blocks[p] = blocks[p] or blocks[i] or page.tags[i] not in _INLINE and page.tags[i] not in _VOID

    top = best[body]
    threshold, least, k = density[top], scaled[top], top
    while k not in (body, -1, 0):
        k = page.parents[k]
        threshold, least = min(threshold, density[k]), min(least, scaled[k])
    chosen = []
    i = body
    while i <= page.last[body]:
        dense = density[i] >= threshold or scaled[i] >= least
        if not density[i] or not dense and linked[i]:
            i = page.last[i] + 1
        elif own_scaled[i] >= least or dense and (best[i] == i or not blocks[i]):
            chosen.append(i)
            i = page.last[i] + 1
        elif not dense:
            i += 1
        else:
            chosen.append(best[i])
            i += 1
    # an article or main element that holds content is content as a whole
    whole = []
    for i in chosen:
        k, out = i, i
        while k > 0:
            if page.tags[k] in _WHOLE:
                out = k
            k = page.parents[k]
        whole.append(out)
    semantic = [i for i in whole if page.tags[i] in _WHOLE]
    keep, end = [], -1
    for i in sorted(set(semantic or whole)):
        if i > end:
            keep.append(i)
            end = page.last[i]
    return keep


def main_text(source: str | None) -> str:
    """The main text of one page."""
    if not source:
        return ""
    page = _Page(source)
    if not page.texts:
        return ""
    articles = [i for i, t in enumerate(page.tags) if t in _WHOLE and not page.cut[i]]
    nodes = _content(page)
    if articles and not any(page.tags[i] in _WHOLE for i in nodes):
        # text outside is denser than a short article: the page itself says which is the content
        total = _densities(page)[1]
        nodes = [max(articles, key=lambda i: (total[i], -i))]
    blocks: list[list[str]] = [[]]
    before = None
    for node, broken, text in page.texts:
        at = bisect.bisect_right(nodes, node) - 1
        inside = nodes[at] if at >= 0 and node <= page.last[nodes[at]] else None
        if broken or inside != before:
            blocks.append([])
        before = inside
        if inside is not None:
            blocks[-1].append(text)
    return " ".join(t for t in (" ".join("".join(b).split()) for b in blocks) if t)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages``."""

    def run(batches):
        for b in slices(batches, "html"):
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    rows = columns(pages, page_id="long", url="string", html="string")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
