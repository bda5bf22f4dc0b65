"""Main text of web pages by tree scoring.

A page becomes a tree by a forgiving parser of its own. Parts that are never article text (scripts, forms, navigation, and what
its tag, role, class or id marks as menu, header, footer, sidebar, notice, advert or comments) leave the tree.
Each paragraph passes points for its length and commas to its ancestors, fewer with each level; a container's score is
discounted by its link density. The article around the best container is kept whole, or else the main around it. Without
either, what stands beside the container and its ancestors stays too, other than what is mostly links.

Defined cases: null and empty pages, and pages without text, give an empty text; markup may be cut or unclosed anywhere;
depth and size are not bounded, as nothing recurses or walks up more than once; of containers with equal scores the first is taken; equal pages give equal texts; other columns are carried.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_slices, table

# Element names by what HTML makes of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split())
CLOSES_P = BLOCK - {"body", "html", "tbody", "thead", "tfoot", "tr", "caption"}
#: An element of the first kind ends an open one of the second, unless one of the third stands between.
IMPLIED = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p pre blockquote td li dd figcaption".split())
NEVER = frozenset("head nav aside footer form menu dialog button select option input fieldset svg math canvas object audio video search".split())
CONTAINERS = frozenset("html body main article section div td th center details blockquote".split())
ROOTS = frozenset("html body main article".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
# What the first part of a class or id says; some words do only with such parts after them, as they have other senses.
AGAINST = frozenset("ad ads adv advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo promotion comment comments commentlist respond reply replies disqus sidebar nav navbar navigation menu breadcrumb breadcrumbs footer topbar cookie cookies consent gdpr notice notification alert newsletter subscribe subscription related recommended recommendations popup modal pagination".split())
MAYBE = frozenset("share sharing social skip legal hidden meta tags tagcloud copyright login signup side foot overlay widget toolbar pager".split())
PARTS = frozenset("link links button buttons bar icon icons box widget wrapper container nav menu navigation notice to content main tools count counts post row area panel".split())
HEADER = frozenset("header masthead".split())

TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*+)((?:[^'">]++|"[^"]*+"|'[^']*+')*+)>""")
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "attributes", "parent", "children", "score", "length", "linked")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.attributes, self.parent, self.children = tag, attributes, parent, []
        self.score, self.length, self.linked = 0.0, 0, 0
        if parent is not None:
            parent.children.append(self)


def parse(html: str) -> Node:
    """The tree of a page; children are nodes and strings."""
    root = Node("html", "", None)
    path = [root]  # the open elements
    depths: dict[str, list[int]] = {}  # where in path those of each tag are; the root's is none
    at, end = 0, len(html)

    def close_to(depth: int) -> None:
        """Ends everything from the innermost open element to that at a depth."""
        while len(path) > depth:
            depths[path.pop().tag].pop()

    def innermost(tags: tuple, barriers: tuple) -> int:
        """The depth of the innermost open element of some tags, or 0 if there is none or a barrier is within it."""
        last = lambda names: max((depths[t][-1] for t in names if depths.get(t)), default=0)
        return depth if (depth := last(tags)) > last(barriers) else 0

    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            path[-1].children.append(unescape(html[at:]))
            break
        if lt > at:
            path[-1].children.append(unescape(html[at:lt]))
        if html.startswith("<!--", lt):
            stop = html.find("-->", lt + 4)
            at = stop + 3 if stop >= 0 else end
            continue
        if html.startswith(("<!", "<?"), lt):
            stop = html.find(">", lt)
            at = stop + 1 if stop >= 0 else end
            continue
        name = html[lt + 1 : lt + 3].lstrip("/")[:1]
        if not (name.isascii() and name.isalpha()):
            path[-1].children.append("<")
            at = lt + 1
            continue
        found = TAG.match(html, lt)
        if found:
            tag, attributes, at = found[1].lower(), found[2], found.end()
        else:  # a quote or the tag itself is never closed
            stop = html.find(">", lt)
            if stop < 0:
                break
            tag, attributes, at = re.match(r"/?([^\s/>]*)", html[lt + 1 : stop])[1].lower(), "", stop + 1
        if html[lt + 1] == "/":
            if depths.get(tag):
                close_to(depths[tag][-1])
            continue
        if tag in CLOSES_P and (depth := innermost(("p",), ("table", "td", "button", "object"))):
            close_to(depth)
        if tag in IMPLIED:
            tags, barriers = IMPLIED[tag]
            while depth := innermost(tags, barriers):
                close_to(depth)
        if tag in ("html", "body") and (tag == "html" or depths.get("body")):
            continue
        node = Node(tag, attributes, path[-1])
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
            at = stop.start() if stop else end
            if stop:
                stop = html.find(">", at)
                at = stop + 1 if stop >= 0 else end
        elif tag not in VOID and not attributes.rstrip().endswith("/") or tag in BLOCK and tag not in VOID:
            depths.setdefault(tag, []).append(len(path))
            path.append(node)
    return root


def nature(node: Node, inside: bool) -> str:
    """keep, drop, or header: a header inside an article keeps its headings. There, words that may mean something else speak against no paragraph."""
    if node.tag in NEVER or node.tag in RAW:
        return "drop"
    found = "header" if node.tag == "header" else "keep"
    if not node.attributes or node.tag in ROOTS - {"article"}:
        return found
    for name, *values in ATTRIBUTE.findall(node.attributes):
        name, value = name.lower(), next((v for v in values if v), "").lower()
        if name == "hidden" and value != "until-found" or name == "aria-hidden" and value == "true" or name == "style" and INVISIBLE.search(value):
            return "drop"
        if name == "role" and value in ROLES:
            return "drop"
        if name in ("class", "id"):
            for part in value.split():
                first, *more = [x for x in re.split(r"[-_:]+|(?<=[a-z])(?=[0-9])", part) if x] or [""]
                if first in HEADER:
                    found = "header"
                elif first in AGAINST or first in MAYBE and PARTS.issuperset(more) and not (inside and node.tag in PARAGRAPHS | HEADINGS):
                    return "drop"
    return found


def prune(root: Node) -> None:
    """Takes out what is never article text."""
    work = [(root, False)]
    while work:
        node, inside = work.pop()
        inside = inside or node.tag in ("article", "main")
        kept = []
        for child in node.children:
            if isinstance(child, Node):
                kind = nature(child, inside)
                if kind == "drop":
                    continue
                if kind == "header":
                    if inside:
                        kept += headings(child)
                    continue
                work.append((child, inside))
            kept.append(child)
        node.children = kept
        for child in kept:
            if isinstance(child, Node):
                child.parent = node


def headings(node: Node) -> list[Node]:
    out, work = [], [node]
    while work:
        here = work.pop()
        if here.tag in HEADINGS:
            out.append(here)
        else:
            work += [c for c in reversed(here.children) if isinstance(c, Node) and nature(c, True) == "keep"]
    return out


def in_order(root: Node) -> list[Node]:
    """All nodes, parents first."""
    out, work = [], [root]
    while work:
        node = work.pop()
        out.append(node)
        work += [c for c in reversed(node.children) if isinstance(c, Node)]
    return out


def score(nodes: list[Node]) -> None:
    """Lengths, linked lengths and scores of all nodes."""
    commas: dict[int, int] = {}
    for node in reversed(nodes):
        own = [" ".join(c.split()) for c in node.children if isinstance(c, str)]
        node.length += sum(map(len, own))
        count = commas.get(id(node), 0) + sum(len(re.findall("[,،、，]", c)) for c in own)
        if node.tag == "a":
            node.linked = node.length
        bare = node.tag in ("div", "section", "article", "main", "body") and sum(map(len, own)) >= 25
        if (node.tag in PARAGRAPHS or bare) and node.length:
            points = (1 + count + min(node.length / 100, 3)) * (1 - node.linked / node.length)
            level, up = 0, node if bare else node.parent
            while up is not None and level < 6:
                up.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
                level, up = level + 1, up.parent
        if node.parent is not None:
            node.parent.length += node.length
            node.parent.linked += node.linked
            commas[id(node.parent)] = commas.get(id(node.parent), 0) + count
    for node in nodes:
        if node.length:
            node.score *= 1 - node.linked / node.length


def without_links(children: list, kept: Node) -> list:
    """children other than blocks, and runs of text between blocks, that are mostly links; kept stays."""
    out: list = []
    run: list = []

    def flush() -> None:
        length = sum(len(" ".join(c.split())) if isinstance(c, str) else c.length for c in run)
        if sum(c.linked for c in run if isinstance(c, Node)) * 2 <= length:
            out.extend(run)
        run.clear()

    for c in children:
        if c is kept or isinstance(c, Node) and c.tag in BLOCK:
            flush()
            if c is kept or c.linked * 2 <= c.length:
                out.append(c)
        else:
            run.append(c)
    flush()
    return out


def chosen(root: Node) -> list[Node]:
    """The nodes whose text is the article, in page order."""
    nodes = in_order(root)
    score(nodes)
    best = max((n for n in nodes if n.tag in CONTAINERS), key=lambda n: n.score, default=root)
    if best.score <= 0:
        return [root]
    lineage, whole = [best], {}
    while lineage[-1].parent is not None:
        lineage.append(lineage[-1].parent)
    for node in lineage:  # the outermost of each
        if node.tag in ("article", "main"):
            whole[node.tag] = node
    if not whole:
        for child, node in zip(lineage[:-1], lineage[1:], strict=True):
            node.children = without_links(node.children, child)
        return [root]
    best = whole.get("article") or whole["main"]
    if best.parent is None:
        return [best]
    least = max(10.0, best.score * 0.2)
    out = []
    for node in best.parent.children:
        if not isinstance(node, Node) or not node.length:
            continue
        density = node.linked / node.length
        text_like = node.tag in ("p", "blockquote", "pre") and (node.length > 80 and density < 0.25 or node.length <= 80 and not node.linked)
        if node is best or node.score >= least and best.tag != "article" or text_like and best.tag != "article" or node.tag == "article" and best.tag == "article" and node.score >= least:
            out.append(node)
        elif node.tag == "h1" and not density:
            out.append(node)
    return out


def blocks(node: Node) -> list[str]:
    """The text of each block, white space as single spaces."""
    out: list[str] = []
    part: list[str] = []

    def flush() -> None:
        text = " ".join("".join(part).split())
        part.clear()
        if text:
            out.append(text)

    work: list = [node]
    while work:
        here = work.pop()
        if here is None:
            flush()
        elif isinstance(here, str):
            part.append(here)
        elif here.tag in ("br", "td", "th"):
            part.append(" ")
            work += reversed(here.children)
        else:
            if here.tag in BLOCK:
                flush()
                work.append(None)
            work += reversed(here.children)
    flush()
    return out


def main_text(html: str | None) -> str:
    """The article's blocks, joined by two line ends; empty if there is none."""
    if not html or html.isspace():
        return ""
    root = parse(html)
    prune(root)
    return "\n\n".join(b for node in chosen(root) for b in blocks(node))


def extract(pages: DataFrame, html: str = "html", out: str = "main_text") -> DataFrame:
    """pages with the main text of each added; a column of this name is replaced."""
    fields = [f for f in pages.schema.fields if f.name != out] + [T.StructField(out, T.StringType())]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x) for x in batch.column(batch.schema.get_field_index(html)).to_pylist()]
        keep = [n for n in batch.schema.names if n != out]
        return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in keep] + [pa.array(texts, pa.string())], [*keep, out])

    return in_slices(pages, html, work, T.StructType(fields), 4 << 20)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
