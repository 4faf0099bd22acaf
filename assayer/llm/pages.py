"""Main text of web pages by tag-path ratios.

A page is cut into blocks: the text between two block-level boundaries. For each root-to-leaf tag path the text
length and the punctuation of its blocks are summed and divided by their number; both ratios, less the share of
linked text, are fused into one score, smoothed over the blocks in page order, and paths above a threshold hold
content. The content region is the element that holds these paths' text: an article or main element, where it
holds most of it, else the deepest element that holds most of it. Blocks of the region are the result, without
what the page itself marks as a menu, header, footer, sidebar, notice, advert, form, script, style or reader comment.

Pages are parsed in Arrow batches, each page by itself, and whole: the work is a scan, nothing is shuffled.

Defined cases: null, empty and blank pages have an empty text, as have pages whose text is all in marked parts.
Broken mark-up is read as browsers do: unclosed elements end with their parent or where the next one implies it,
stray end tags count for nothing, an unclosed comment, script or tag takes the rest. Very long pages are read whole,
in time linear in their length. Repeated pages are repeated in the result. Extra columns are dropped unless ``keep``
names them, whatever their names are.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm._work import releasing, ship

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their own end tag.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in "script style textarea title xmp iframe noembed noframes".split()}
BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6
    head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul""".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Never part of an article, whatever it holds.
EXCLUDED = frozenset(
    "aside audio button canvas datalist dialog footer form head iframe input menu nav noembed noframes noscript object script select style svg template textarea title video".split()
)
#: Parts of class names, ids and roles that mark what is not the article.
MARKS = frozenset(
    """ad ads adv advert adverts advertisement advertisements advertising adbox adslot adsense banner banners sponsor sponsored sponsors promo promos promotion
    nav navbar navigation menu menus menubar breadcrumb breadcrumbs pagination pager toolbar topbar masthead header footer bottombar contentinfo
    sidebar sidebars aside complementary rail widget widgets related recommended recommendations trending
    cookie cookies consent gdpr notice notices alert alertdialog dialog popup popups modal overlay newsletter subscribe subscription signup login paywall disclaimer
    comment comments commentlist discussion disqus respond reply replies share sharing social search form""".split()
)
#: Elements that hold everything, and so are not marked by their classes.
WHOLE = frozenset("html body main article".split())
#: What an opening tag ends, and the elements beyond which it does not look.
_P_ENDS = BLOCK - frozenset("body caption dd dt frameset head html legend li optgroup option tbody td tfoot th thead tr".split())
_IMPLIED: dict[str, tuple[frozenset, frozenset]] = {t: (frozenset(["p"]), frozenset("button caption html object table td template th".split())) for t in _P_ENDS}
_LISTS = frozenset("ul ol menu dir dl table html td th".split())
for _t, _ends, _stops in (
    ("li", ["li"], _LISTS), ("dt", ["dt", "dd"], _LISTS), ("dd", ["dt", "dd"], _LISTS), ("option", ["option"], {"select", "datalist", "html"}),
    ("tr", ["tr"], {"table", "html"}), ("td", ["td", "th"], {"table", "tr", "html"}), ("th", ["td", "th"], {"table", "tr", "html"}),
    ("tbody", ["thead", "tbody", "tfoot"], {"table", "html"}), ("thead", ["thead", "tbody", "tfoot"], {"table", "html"}), ("tfoot", ["thead", "tbody", "tfoot"], {"table", "html"}),
):
    _IMPLIED[_t] = (frozenset(_ends), frozenset(_stops))
_END_STOPS = frozenset("caption html object table td template th".split())
_TABLE_STOPS = frozenset(["table", "html"])
_TABLE = frozenset("caption table tbody td tfoot th thead tr".split())

_TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+(?:>|\Z)|[^>]*(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/>"']|\Z)""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
#: Deeper elements are read as siblings, as browsers do.
DEPTH = 512
#: Share of the content text that a region must hold.
MOST = 0.7
#: Weights of the smoothing over neighbouring blocks.
SMOOTH = (0.25, 0.5, 0.25)
#: From this share of linked text a block is a link.
LINKED = 0.8


def _marked(tag: str, attributes: str) -> bool:
    """Whether the element's own attributes say that it is no part of an article, or unseen."""
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _UNSEEN.search(value)):
            return True
        if name in ("class", "id", "role") and tag not in WHOLE:
            for word in value.split():
                parts = [p.lower() for p in _PARTS.findall(word)]
                if parts and parts[0] not in ("has", "with", "no", "without") and not MARKS.isdisjoint(parts):
                    return True
    return False


class _Page:
    """Blocks of one page: ``[node, text pieces, linked characters, excluded]``, and the tree of block-level elements."""

    def __init__(self, source: str):
        self.parent, self.tag, self.path = [-1], ["#"], [0]
        self.paths: dict[tuple[int, str], int] = {}
        self.blocks: list[list] = []
        self.unclosed: dict[str, int] = {}
        self._open: list | None = None
        #: (tag, node, excluded, inside a link, inside an article)
        self.stack: list[tuple[str, int, bool, bool, bool]] = [("#", 0, False, False, False)]
        at, n = 0, len(source)
        while at < n:
            found = _TOKEN.search(source, at)
            if not found:
                self._text(source[at:])
                break
            if found.start() > at:
                self._text(source[at : found.start()])
            at = found.end()
            name = found[2]
            if name is None:
                continue
            name = name.lower()
            if found[1]:
                self._end(name)
                continue
            self._start(name, found[3])
            if name in RAW:
                stop = RAW[name].search(source, at)
                at = stop.start() if stop else n  # scripts, styles and the like are no text

    def _text(self, text: str) -> None:
        _, node, excluded, linked, _ = self.stack[-1]
        b = self._open
        if b is None or b[3] != excluded and not b[1]:
            if not text.strip():
                return
            b = self._open = [node, [], 0, excluded]
            self.blocks.append(b)
        if excluded and not b[3]:
            return  # an unseen or marked element within a line
        if b[3] and not excluded:
            b[3], b[1], b[2] = False, [], 0
        if "&" in text:
            text = entities.unescape(text)
        b[1].append(text)
        if linked:
            b[2] += len("".join(text.split()))

    def _start(self, name: str, attributes: str) -> None:
        if name == "br":
            if self._open:
                self._open[1].append(" ")
            return
        if name in BLOCK:
            self._open = None
            if name in _IMPLIED:
                self._close(*_IMPLIED[name])
            if name in HEADINGS and self.stack[-1][0] in HEADINGS:
                self._pop(len(self.stack) - 1)
        if name in VOID:
            return
        if len(self.stack) > DEPTH:
            self._pop(DEPTH)
        _, node, excluded, linked, article = self.stack[-1]
        if name in BLOCK:
            key = (self.path[node], name)
            path = self.paths.setdefault(key, len(self.paths) + 1)
            self.parent.append(node)
            self.tag.append(name)
            self.path.append(path)
            node = len(self.parent) - 1
        if not excluded:
            excluded = name in EXCLUDED or (name == "header" and not article) or (attributes != ">" and _marked(name, attributes))
        self.stack.append((name, node, excluded, linked or name == "a", article or name in ("article", "main")))
        self.unclosed[name] = self.unclosed.get(name, 0) + 1

    def _end(self, name: str) -> None:
        if name in BLOCK:
            self._open = None
        self._close((name,), _TABLE_STOPS if name in _TABLE else _END_STOPS if name in BLOCK else BLOCK)

    def _close(self, names: Iterable[str], stops: frozenset) -> None:
        """Ends the innermost open element of ``names``, unless one of ``stops`` lies within it."""
        if any(self.unclosed.get(x) for x in names):
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i][0] in names:
                    return self._pop(i)
                if self.stack[i][0] in stops:
                    return None
        return None

    def _pop(self, to: int) -> None:
        for name, *_ in self.stack[to:]:
            self.unclosed[name] -= 1
        del self.stack[to:]


def path_scores(paths: list[int], chars: list[int], marks: list[int], linked: list[int]) -> list[float]:
    """A smoothed score of each block: text and punctuation a block of its path, fused, less linked text."""
    sums: dict[int, list[int]] = {}
    for p, c, m, k in zip(paths, chars, marks, linked, strict=True):
        s = sums.setdefault(p, [0, 0, 0, 0])
        s[0] += c
        s[1] += m
        s[2] += k
        s[3] += 1
    fused = {p: (c / n) * (1 + m / n) * (1 - k / c if c else 0) for p, (c, m, k, n) in sums.items()}
    own = [fused[p] for p in paths]
    left, right = [own[:1], *[[x] for x in own[:-1]]], [*[[x] for x in own[1:]], own[-1:]]
    return [SMOOTH[0] * a[0] + SMOOTH[1] * x + SMOOTH[2] * b[0] for a, x, b in zip(left, own, right, strict=True)] if own else []


def extract(source: str | None) -> str:
    """The main text of a page: its blocks in order, joined by line feeds."""
    if not source or not source.strip():
        return ""
    page = _Page(source)
    blocks = []
    for node, pieces, linked, excluded in page.blocks:
        text = " ".join("".join(pieces).split())
        if text:
            blocks.append((node, text, linked, excluded))
    if not blocks:
        return ""
    chars = [len(t) - t.count(" ") for _, t, _, _ in blocks]
    paths = [page.path[node] for node, _, _, _ in blocks]
    scores = path_scores(paths, chars, [len(_PUNCTUATION.findall(t)) for _, t, _, _ in blocks], [k for _, _, k, _ in blocks])
    mean = sum(scores) / len(scores)
    threshold = min(math.sqrt(sum((x - mean) ** 2 for x in scores) / len(scores)), max(scores) / 2)
    content = {p for p, s, (_, _, _, out) in zip(paths, scores, blocks, strict=True) if not out and s >= threshold}
    region, semantic = _region(page, blocks, chars, paths, content)
    if region < 0:
        return ""
    inside = [False] * len(page.parent)
    for node in range(region, len(page.parent)):
        inside[node] = node == region or (page.parent[node] >= region and inside[page.parent[node]])
    kept = []
    menus = _menus(page, blocks, chars)
    for i, (node, text, linked, out) in enumerate(blocks):
        if out or not inside[node] or node in menus:
            continue
        plain = linked < LINKED * chars[i]
        in_flow = page.tag[node] in HEADINGS or page.tag[node] in ("p", "li", "blockquote", "pre", "td", "th", "dt", "dd", "figcaption", "caption")
        if semantic or paths[i] in content or (plain and in_flow):
            kept.append(text)
    return "\n".join(kept)


def _menus(page: _Page, blocks: list, chars: list[int]) -> set[int]:
    """List items of lists that are links throughout, three or more."""
    item = [0] * len(page.parent)  # the list item around each element, if any
    for node in range(1, len(page.parent)):
        item[node] = node if page.tag[node] == "li" else 0 if page.tag[node] in WHOLE else item[page.parent[node]]
    lists: dict[int, list[tuple[int, bool]]] = {}
    for (node, _, linked, _), c in zip(blocks, chars, strict=True):
        if item[node]:
            lists.setdefault(page.parent[item[node]], []).append((node, linked >= LINKED * c))
    return {node for items in lists.values() if len(items) > 2 and all(x for _, x in items) for node, _ in items}


def _region(page: _Page, blocks: list, chars: list[int], paths: list[int], content: set[int]) -> tuple[int, bool]:
    """The element that holds the content, and whether the page calls it an article or its main part."""
    n = len(page.parent)
    held, all_held = [0] * n, [0] * n
    for (node, _, _, out), c, p in zip(blocks, chars, paths, strict=True):
        if not out:
            held[node] += c if p in content else 0
            all_held[node] += c
    for node in range(n - 1, 0, -1):
        held[page.parent[node]] += held[node]
        all_held[page.parent[node]] += all_held[node]
    for kind in ("article", "main"):
        best = max((x for x in range(1, n) if page.tag[x] == kind and all_held[x]), key=lambda x: (all_held[x], -x), default=-1)
        if best > 0 and 2 * all_held[best] >= all_held[0]:
            return best, True
    if not held[0]:
        return -1, False
    region = 0
    for node in range(1, n):
        if page.parent[node] == region and held[node] >= MOST * held[0]:
            region = node
    while page.tag[region] in ("p", *HEADINGS) and page.parent[region] > 0:
        region = page.parent[region]
    return region, False


def main_text(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep``, and the main text of the whole ``html`` of each row as ``text``, with ``n_chars`` code points."""
    ship(pages.sparkSession)
    row = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{html}`").cast("string").alias("html"))
    schema = row.select("row", F.col("html").alias("text")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    out = row.mapInArrow(releasing(run), schema)
    return out.select("row.*", "text", F.length("text").cast("long").alias("n_chars"))
