"""Main text of HTML pages by a site style tree.

The DOMs of one host are merged into a style tree: for every element path, the pages that hold it, the child
sequences (presentations) with which it occurs there, and the hashes of its branch's text (contents). An element
that many pages show in the same way with the same content has low entropy, so low importance, and its
branch is removed from the pages. Importance is the larger of presentation and content entropy, the latter
times DAMPING; as content is that of the whole branch, an element lives as long as something below it varies. Elements whose tag, role or class says what they are (navigation, footers, adverts, forms,
comments, ...) have no importance from the start; article and main elements have full importance, and a page
that has one is read from it alone, without the branches of low importance inside it. Identical pages of a host are merged once, so copies don't make an
article look like a template. Names of classes and ids don't judge article and main elements or headings.

Defined cases: null and empty html give empty text; pages without host share one tree; elements may be nested to any depth; repeated
page_ids and extra columns are kept or ignored row by row; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import counted, cut, forget
from .url_filter import host_path

#: Pages that must show an element before it is called a template; importance below which a branch goes; weight of content.
MIN_PAGES, THRESHOLD, DAMPING = 8, 0.25, 0.9
#: Template paths (of 8 bytes) that may be broadcast; beyond that pages meet them by a join on the host.
MOST_BROADCAST = 1_000_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])|\Z", re.I) for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "plaintext")}
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "option", "optgroup", "li", "dd", "dt"}
#: A start tag on the left ends an open element on the right, up to an element in the third place.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_SCOPE = frozenset({"table", "td", "th", "caption", "button", "html", "object", "template"})
_NOISE_TAGS = frozenset("nav header footer aside form script style noscript template iframe object embed svg math canvas button select option textarea input label fieldset dialog menu head title audio video map".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_NOISE_WORDS = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adsbygoogle|sponsor(?:ed)?|promo(?:tion)?s?|banners?|sidebars?|nav|navbar|navigation|menus?|breadcrumbs?|footers?|masthead|headers?|cookies?|consent|gdpr|notices?|newsletter|subscribe|signup|login|popup|modal|overlay|comments?|disqus|replies|reply|respond|share|sharing|social|related|recommended|widgets?|pagination|pager|toolbar|search(?:box|form)?|disclaimer|copyright)(?=$|[\s_-])", re.I)
_MAIN = frozenset({"article", "main"})
_UNJUDGED = frozenset("html body h1 h2 h3 h4 h5 h6".split())
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "kind", "noise", "main", "items")

    def __init__(self, tag: str, kind: str, noise: bool, main: bool) -> None:
        self.tag, self.kind, self.noise, self.main = tag, kind, noise, main
        self.items: list[Node | str] = []


def parse(source: str) -> Node:
    """A tolerant DOM: items of a node are its texts (references decoded) and elements in order."""
    root = Node("#root", "#root", False, False)
    stack, at, n = [root], 0, len(source)
    open_tags: Counter = Counter()  # of the stack
    mains = 0  # of the stack

    def shut(i: int) -> None:
        """Closes the elements from place i of the stack on."""
        nonlocal mains
        for x in stack[i:]:
            open_tags[x.tag] -= 1
            mains -= x.main
        del stack[i:]

    def text(s: str) -> None:
        if s:
            stack[-1].items.append(entities.unescape(s) if "&" in s else s)

    while at < n:
        open_ = source.find("<", at)
        if open_ < 0:
            text(source[at:])
            break
        m = _TOKEN.match(source, open_)
        if m is None:
            text(source[at : open_ + 1])
            at = open_ + 1
            continue
        text(source[at:open_])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1) if open_tags[tag] else ():
                if stack[i].tag == tag:
                    shut(i)
                    break
                if stack[i].main and tag not in _MAIN and tag not in ("body", "html"):
                    break  # a stray end tag doesn't leave an article
            continue
        if tag in _CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    shut(i)
                    break
                if stack[i].tag in _SCOPE or stack[i].tag in _BLOCK:
                    break
        elif tag in _ENDS:
            ended, until = _ENDS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ended:
                    shut(i)
                    break
                if stack[i].tag in until:
                    break
        names, role, hidden = [], "", False
        if m[3]:
            for a in _ATTR.finditer(m[3]):
                value, key = (a[2] or a[3] or a[4] or "").strip(), a[1].lower()
                if key in ("class", "id"):
                    names.append(value)
                elif key == "role":
                    role = value.lower()
                elif key == "style":
                    hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
                else:
                    hidden |= key == "hidden" or value.lower() == "true"
        label = " ".join(names)
        main = tag in _MAIN or role in ("main", "article")
        noise = hidden or (tag in _NOISE_TAGS and not (tag == "header" and mains)) or role in _NOISE_ROLES or bool(label and not main and tag not in _UNJUDGED and _NOISE_WORDS.search(label))
        node = Node(tag, f"{tag}.{label}" if label else tag, noise, main)
        stack[-1].items.append(node)
        if tag in _RAW:
            end = _RAW[tag].search(source, at)
            node.items.append(source[at : end.start()])
            close = source.find(">", end.start())
            at = n if end.start() == n or close < 0 else close + 1
        elif tag not in _VOID and not (m[3] or "").endswith("/"):
            stack.append(node)
            open_tags[tag] += 1
            mains += main
    return root


def _main_nodes(root: Node) -> list[tuple[Node, int]]:
    """The outermost article or main elements outside noise, with the paths of their parents."""
    out, todo = [], [(root, 0)]
    while todo:
        node, path = todo.pop()
        if node.noise:
            continue
        if node.main:
            out.append((node, path))
        else:
            path = _step(path, node.kind)
            todo += [(x, path) for x in reversed(node.items) if isinstance(x, Node)]
    return out


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)


def _step(path: int, kind: str) -> int:
    """The path of an element of this kind below another, as a hash."""
    return _hash(f"{path}/{kind}")


def branches(root: Node) -> Iterator[tuple[int, int, int]]:
    """(path, presentation, content) of the elements outside noise. Content is the text of the whole branch."""
    found: list[tuple[int, int, int, str]] = []  # path, place of the parent, presentation, own text
    todo = [(root, 0, -1)]
    while todo:
        node, path, above = todo.pop()
        if node.noise:
            continue
        path = _step(path, node.kind)
        kids = [x for x in node.items if isinstance(x, Node) and not x.noise]
        todo += [(k, path, len(found)) for k in kids]
        found.append((path, above, _hash(">".join(dict.fromkeys(k.kind for k in kids))), " ".join(" ".join(x for x in node.items if isinstance(x, str)).split())))
    below: list[list[int]] = [[] for _ in found]
    for i in range(len(found) - 1, -1, -1):  # children stand after their parent
        path, above, presentation, text = found[i]
        content = _hash(f"{text}>{below[i]}")
        if above >= 0 and (text or below[i]):
            below[above].append(content)
        yield path, presentation, content


def extract(source: str | None, removed: frozenset[int] = frozenset()) -> str:
    """The page's main text: blocks joined by two newlines, without noise and the removed paths."""
    if not source:
        return ""
    root = parse(source)
    mains = _main_nodes(root)
    blocks, run = [], []

    def flush() -> None:
        s = _SPACE.sub(" ", "".join(run)).strip()
        if s:
            blocks.append(s)
        run.clear()

    todo: list = list(reversed(mains)) or [(root, 0)]
    while todo:
        x, path = todo.pop()
        if x is flush:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif x.tag == "br" or x.tag == "wbr":
            run.append(" " if x.tag == "br" else "")
        elif not x.noise:
            path = _step(path, x.kind)
            if removed and not x.main and path in removed:
                continue
            if x.tag in _BLOCK or x.tag == "#root":
                flush()
                todo.append((flush, None))
            todo += [(y, path) for y in reversed(x.items)]
    flush()
    return "\n\n".join(blocks)


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Elements of pages."""
    for b in batches:
        out = []
        for host, source in zip(b["host"], b["html"], strict=True):
            if isinstance(source, str) and source:
                page = _hash(source)
                out += [(host, page, *x) for x in branches(parse(source))]
        yield pd.DataFrame(out, columns=["host", "page", "path", "presentation", "content"])


def template_paths(seen: DataFrame) -> DataFrame:
    """(host, path) of low importance in the style trees of hosts, from the distinct elements of pages (:func:`elements`)."""
    pages_with = seen.groupBy("host", "path").agg(F.count_distinct("page").alias("pages"))

    def entropy(c: str, name: str) -> DataFrame:
        """Entropy over the element's variants, to the base of their number in the pages: 1 if every page has its own, 0 if all are alike."""
        n = seen.groupBy("host", "path", c).agg(F.count(F.lit(1)).alias("n"))
        total = n.groupBy("host", "path").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log("n")).alias("s"))
        return total.select("host", "path", F.when(F.col("t") > 1, F.greatest(F.lit(0.0), 1 - F.col("s") / (F.col("t") * F.log("t")))).otherwise(1.0).alias(name))

    style = pages_with.join(entropy("presentation", "presentation"), ["host", "path"]).join(entropy("content", "content"), ["host", "path"])
    whole = style.withColumn("importance", F.greatest("presentation", F.lit(DAMPING) * F.col("content")))
    return whole.filter((F.col("pages") >= MIN_PAGES) & (F.col("importance") < THRESHOLD)).select("host", "path")


def _extractor(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        removed = b["removed"] if "removed" in b else [None] * len(b)
        texts = [extract(s if isinstance(s, str) else None, frozenset() if r is None else frozenset(r)) for s, r in zip(b["html"], removed, strict=True)]
        yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})


def elements(pages: DataFrame) -> DataFrame:
    """host, page, path, presentation, content: the distinct elements of the pages (host, html)."""
    return pages.select("host", "html").mapInPandas(_features, "host string, page long, path long, presentation long, content long").distinct()


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html).

    Template paths of a host (bounded by its distinct element paths) come to its pages by a broadcast, if they are few (they are counted),
    else by a join on the host, whose skew adaptive execution splits.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_path(F.col("url"))[0].alias("host"))
    seen = cut(elements(pages))
    paths, n = counted(template_paths(seen))
    forget(seen)
    if n:
        found = paths.groupBy("host").agg(F.collect_list("path").alias("removed"))
        pages = pages.join(F.broadcast(found) if n <= MOST_BROADCAST else found, "host", "left")
    return pages.mapInPandas(_extractor, "page_id long, url string, text string, n_chars long")
