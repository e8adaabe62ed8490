"""Main text of web pages by wrapper induction.

Every page's DOM tree is aligned with the tree of its host's reference page (the one with the smallest id) by simple
tree matching: two nodes match if their tags do, and children are matched in order so that the matched nodes are most.
Over all pages of a host it is counted how often each text node of the reference was matched and with the same text.
A node that is the same on nearly all pages is constant and belongs to the template; what varies is content.  Counts
are summed within each batch before the shuffle, so a host with a third of all pages is a few rows a task.

The article is then the region (article, main, or the densest container) with the most varying text.  Inside it the
template's nodes and what its markup marks as menus, forms, adverts, notices or reader comments are left out; where
most of an article would be constant, its pages are copies of each other, and nothing of it is taken for template.

Defined results: null or empty html gives the empty text; pages without a host, and hosts of fewer than ``LEAST``
pages, have no template; repeated rows are returned each; null ids never serve as reference unless there is no other.
"""

from __future__ import annotations

import functools
import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_LIMIT_BYTES, cut, map_batches, slices

LEAST, SHARE, NAME_WORDS = 5, 0.9, 3

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "body", "html", "figcaption", "summary"}
NOISE_TAGS = frozenset("nav footer aside form button select option datalist label menu dialog head".split()) | RAW
NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices alert newsletter subscribe subscription popup modal sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs pagination pager footer masthead share sharing social related recommended recommendations comment comments disqus reply replies respond widget widgets toolbar login signup search skip".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>""", re.S)
#: One attribute after another, so that a name inside another one's value is no attribute.
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")


class Node:
    __slots__ = ("index", "kids", "noise", "sig", "tag", "text")

    def __init__(self, tag: str, noise: int = 0, text: str = ""):
        self.tag, self.noise, self.text, self.kids, self.sig, self.index = tag, noise, text, [], 0, -1


@functools.lru_cache(20_000)
def _marked(attrs: str) -> int:
    """0, or 1 if names mark an element as no content, or 2 if they mark a header, which inside an article is kept.

    A class or id of more than ``NAME_WORDS`` words is a sentence, such as a heading's anchor, and names no part of a page."""
    out = 0
    for name, *values in _ATTR.findall(attrs):
        value = html.unescape("".join(values))
        name = name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in NOISE_ROLES:
            return 1
        if name in ("class", "id"):
            for token in value.split():
                parts = [p.lower() for p in _NAME.findall(token) if not p.isdigit()]
                if len(parts) <= NAME_WORDS:
                    if not NOISE_NAMES.isdisjoint(parts):
                        return 1
                    if "header" in parts:
                        out = 2
    return out


def parse(page: str) -> Node:
    """A forgiving DOM: elements and text nodes; raw elements have no children, comments go."""
    root = Node("#root")
    stack, pos, n = [root], 0, len(page)
    lowered = None
    while pos < n:
        m = _TAG.search(page, pos)
        end = m.start() if m else n
        if end > pos:
            stack[-1].kids.append(Node("#text", 0, page[pos:end]))
        if not m:
            break
        pos = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == name:
                    del stack[k:]
                    break
                if stack[k].tag in ("td", "th", "table") and name not in ("tr", "table", "tbody", "thead", "tfoot", "body", "html"):
                    break
            continue
        if name in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in BLOCK:
                    break
        elif name in ("li", "dd", "dt", "tr", "td", "th", "option"):
            same = {"dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th")}.get(name, (name,))
            stop = ("ul", "ol", "dl", "table", "select", "tbody", "thead", "tfoot")
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in stop:
                    break
                if stack[k].tag in same and (name != "tr" or stack[k].tag == "tr"):
                    del stack[k:]
                    break
        attrs = m[3]
        node = Node(name, 1 if name in NOISE_TAGS else (_marked(attrs) if attrs.strip("/ \n\t") else 0) or (2 if name == "header" else 0))
        if name not in ("html", "body") or not any(s.tag == name for s in stack):
            stack[-1].kids.append(node)
        elif name in ("html", "body"):
            continue
        if name in ("html", "body", "main", "article"):
            node.noise = 0
        if name in RAW:
            lowered = lowered if lowered is not None else page.lower()
            close = lowered.find("</" + name, pos)
            close = n if close < 0 else close
            stop = page.find(">", close)
            pos = n if stop < 0 else stop + 1
        elif name not in VOID and not attrs.endswith("/"):
            stack.append(node)
    return root


class Matcher:
    """Simple tree matching; results are kept by the structures of the two trees."""

    def __init__(self, bound: int = 200_000):
        self.sigs: dict[tuple, int] = {}
        self.weights: dict[tuple[int, int], int] = {}
        self.maps: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.shape: dict[int, tuple] = {}
        self.bound = bound

    def reset_if_full(self) -> bool:
        if len(self.sigs) + len(self.weights) + len(self.maps) > self.bound:
            self.__init__(self.bound)
            return True
        return False

    def sign(self, node: Node, start: int = 0) -> int:
        """Number the nodes in page order and give each the identity of its structure, without texts."""
        todo, order = [node], []
        while todo:
            x = todo.pop()
            x.index = start + len(order)
            order.append(x)
            todo.extend(reversed(x.kids))
        for x in reversed(order):
            key = (x.tag, *(k.sig for k in x.kids))
            x.sig = self.sigs.setdefault(key, len(self.sigs) + 1)
            self.shape[x.sig] = key
        return len(order)

    def weight(self, a: int, b: int) -> int:
        """How many nodes of the two structures match at most."""
        got = self.weights.get((a, b))
        if got is None:
            x, y = self.shape[a], self.shape[b]
            got = 0 if x[0] != y[0] else 1 + self._children(a, b)[1]
            self.weights[a, b] = got
        return got

    def pairs(self, a: int, b: int) -> list[tuple[int, int]]:
        """Which children of two nodes with one tag match."""
        return self._children(a, b)[0]

    def _children(self, a: int, b: int) -> tuple[list[tuple[int, int]], int]:
        got = self.maps.get((a, b))
        if got is None:
            got = self.maps[a, b] = self._match(self.shape[a][1:], self.shape[b][1:])
        return got

    def _match(self, x: tuple, y: tuple) -> tuple[list[tuple[int, int]], int]:
        if not x or not y:
            return [], 0
        if x == y:
            return [(i, i) for i in range(len(x))], sum(self.weight(s, s) for s in x)
        kx, ix = np.unique(np.array(x), return_inverse=True)
        ky, iy = np.unique(np.array(y), return_inverse=True)
        w = np.array([[self.weight(int(p), int(q)) for q in ky] for p in kx], np.int32)[ix][:, iy]
        best = np.zeros((len(x) + 1, len(y) + 1), np.int32)
        for i in range(len(x)):
            np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + w[i]), out=best[i + 1, 1:])
        out, i, j = [], len(x), len(y)
        while i and j:
            if best[i, j] == best[i - 1, j]:
                i -= 1
            elif best[i, j] == best[i, j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((i, j))
        return out[::-1], int(best[-1, -1])


_matcher = Matcher()
_references: dict[str, Node] = {}


def _squeeze(text: str) -> str:
    return " ".join(html.unescape(text).split())


def _matched(ref: Node, page: Node):
    """Matched text nodes (of the reference, of the page)."""
    todo = [(ref, page)] if ref.tag == page.tag else []
    while todo:
        a, b = todo.pop()
        if a.tag == "#text":
            yield a, b
        elif a.kids and b.kids:
            todo += [(a.kids[i], b.kids[j]) for i, j in _matcher.pairs(a.sig, b.sig)]


def _reference(page: str) -> Node:
    if _matcher.reset_if_full():
        _references.clear()
    got = _references.get(page)
    if got is None:
        if len(_references) >= 256:
            _references.clear()
        got = parse(page)
        _matcher.sign(got)
        _references[page] = got
    return got


def _regions(root: Node) -> tuple[list[Node], list[Node]]:
    """Article and main elements in page order, not inside noise."""
    articles, mains, todo = [], [], [root]
    while todo:
        x = todo.pop()
        if x.noise == 1:
            continue
        if x.tag == "article":
            articles.append(x)
        elif x.tag == "main":
            mains.append(x)
        todo.extend(reversed(x.kids))
    return articles, mains


def _size(x: Node, template: set[int], inside: bool, links: bool = True) -> int:
    """Characters of varying content below a node."""
    total, todo = 0, [x]
    while todo:
        y = todo.pop()
        if y.tag == "#text":
            if y.index not in template:
                total += len(y.text.strip())
        elif y.noise != 1 and (inside or y.noise != 2) and (links or y.tag != "a"):
            todo += y.kids
    return total


def _main(root: Node, template: set[int]) -> tuple[Node, bool]:
    """The region that holds the article, and whether headers in it belong to it."""
    articles, mains = _regions(root)
    if articles:
        sizes = [_size(a, template, True) for a in articles]
        best = max(range(len(articles)), key=lambda k: (sizes[k], -k))
        if sizes[best] and not any(2 * sizes[best] < _size(m, template, True) for m in mains):
            return articles[best], True
    if mains:
        sizes = [_size(m, template, True) for m in mains]
        if max(sizes):
            return mains[sizes.index(max(sizes))], True
    if articles and max(sizes := [_size(a, template, True) for a in articles]):
        return articles[sizes.index(max(sizes))], True
    scores: dict[int, list] = {}
    todo: list[tuple[Node, Node | None, Node | None]] = [(root, None, None)]
    while todo:
        x, up, upper = todo.pop()
        if x.noise:
            continue
        if x.tag in ("p", "pre", "blockquote", "h1", "h2", "h3", "li", "td", "dd") and up is not None:
            own = _size(x, template, False, links=False)
            for node, share in ((up, 1.0), (upper, 0.5)):
                if node is not None:
                    scores.setdefault(id(node), [node, 0.0])[1] += own * share
        todo += [(k, x, up) for k in reversed(x.kids) if k.tag != "#text"]
    best_node = max(scores.values(), key=lambda s: s[1])[0] if scores else root
    return (best_node, False) if _size(best_node, template, False) else (root, False)


def blocks(region: Node, template: set[int], inside: bool) -> list[str]:
    """The region's text by blocks, in page order, without noise and template nodes."""
    out: list[str] = []
    parts: list[str] = []

    def close() -> None:
        if parts:
            if t := _squeeze("".join(parts)):
                out.append(t)
            parts.clear()

    todo: list[Node | None] = [region]
    while todo:
        x = todo.pop()
        if x is None:
            close()
        elif x.tag == "#text":
            if x.index not in template:
                parts.append(x.text)
        elif x.tag == "br":
            parts.append(" ")
        elif x is not region and (x.noise == 1 or x.noise == 2 and not inside):
            close()
        else:
            if x.tag in BLOCK:
                close()
                todo.append(None)
            todo.extend(reversed(x.kids))
    close()
    return out


def main_text(page: str, reference: str | None = None, constant: frozenset[int] | set[int] = frozenset()) -> str:
    """The article of one page, given its host's reference page and the indexes of that page's constant text nodes."""
    if not page or not page.strip():
        return ""
    ref = _reference(reference) if reference and constant else None
    root = parse(page)
    _matcher.sign(root)
    template: set[int] = set()
    if ref is not None:
        template = {b.index for a, b in _matched(ref, root) if a.index in constant and (a.text == b.text or _squeeze(a.text) == _squeeze(b.text))}
    region, inside = _main(root, template)
    if template:
        whole, left = _size(region, set(), inside), _size(region, template, inside)
        if 2 * left < whole:  # copies of one article, not a template
            template = set()
    return "\n\n".join(blocks(region, template, inside))


def equal_nodes(page: str, reference: str) -> list[int]:
    """The reference's text nodes that the page matches with the same text."""
    ref = _reference(reference)
    root = parse(page)
    _matcher.sign(root)
    return [x.index for x, y in _matched(ref, root) if x.text == y.text or _squeeze(x.text) == _squeeze(y.text)]


def reference_pages(pages: DataFrame) -> DataFrame:
    """(host, reference, pages): each host's page with the smallest id."""
    return pages.where("host <> '' and html is not null").groupBy("host").agg(F.min_by("html", F.struct(F.col("page_id").isNull(), "page_id", F.xxhash64("html"))).alias("reference"), F.count("*").alias("pages")).where(F.col("pages") >= LEAST)


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, reference, constant): the reference page and the sorted indexes of its constant text nodes."""
    refs = cut(reference_pages(pages), "references")

    def align(batches):
        for b in slices(batches):
            seen: dict[tuple[str, int], int] = {}
            for host, page, reference in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                for node in equal_nodes(page, reference):
                    seen[host, node] = seen.get((host, node), 0) + 1
            hosts, nodes = zip(*seen, strict=True) if seen else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(nodes, pa.int32()), pa.array(seen.values(), pa.int64())], names=["host", "node", "same"])

    joined = pages.where("html is not null").select("host", "html").join(_checked(refs.drop("pages")), "host")
    same = map_batches(joined.select("host", "html", "reference"), align, "host string, node int, same long").groupBy("host", "node").agg(F.sum("same").alias("same"))
    constant = same.join(refs.select("host", "pages"), "host").where(F.col("same") >= F.col("pages") * SHARE).groupBy("host").agg(F.sort_array(F.collect_list("node")).alias("constant"))
    return refs.drop("pages").join(constant, "host", "left")


def _checked(refs: DataFrame) -> DataFrame:
    """Broadcast the reference pages if their counted bytes allow."""
    size = refs.agg(F.sum(F.octet_length("reference") + 64)).first()[0] or 0
    return F.broadcast(refs) if size <= BROADCAST_LIMIT_BYTES else refs


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of (page_id, url, html)."""
    kind = dict(pages.dtypes)["page_id"]
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    base = pages.select("page_id", "url", "html", host.alias("host"))
    rules = cut(wrappers(base), "wrappers")

    def run(batches):
        for b in slices(batches):
            if b.num_rows:
                sets: dict[int, frozenset[int]] = {}
                texts = []
                refs, const = b.column(3).to_pylist(), b.column(4)
                for i, page in enumerate(b.column(2).to_pylist()):
                    own = frozenset(const[i].as_py() or ()) if refs[i] is not None else frozenset()
                    texts.append(main_text(page or "", refs[i], sets.setdefault(hash(own), own)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_batches(base.join(_checked(rules), "host", "left").select("page_id", "url", "html", "reference", "constant"), run, f"page_id {kind}, url string, text string, n_chars long")
