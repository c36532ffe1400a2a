"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of block elements and text blocks. Every node is content or not; potentials between
parent and child and evidence at each node (tag, class words, links, length, punctuation) are counts from
labelled pages. Sum-product messages go from the leaves to the root and back, which gives exact marginals;
text blocks that are content more likely than not make up the text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import text_of
from vitrine.session import landed

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPACES = re.compile(r"\s+")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# Elements whose content is not text, elements without content, and block elements.
RAW = frozenset("script style noscript template iframe svg math textarea select object canvas title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html head body address article aside blockquote button caption center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup legend li main menu nav ol option p pre section "
    "summary table tbody td tfoot th thead tr ul label".split()
)
_CLOSES_P = BLOCK - frozenset("button label option legend summary".split())
_SELF_CLOSING = {
    "li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)),
    "tr": ("tr td th", ("table",)), "td": ("td th", ("tr",)), "th": ("td th", ("tr",)), "option": ("option", ("form",)),
}


class Node:
    __slots__ = ("parent", "tag", "names", "text", "links", "mark")

    def __init__(self, parent: int, tag: str, names: str = "", text: str = "", links: int = 0, mark: int = -1):
        self.parent, self.tag, self.names, self.text, self.links, self.mark = parent, tag, names, text, links, mark


def parse(page: str) -> list[Node]:
    """Nodes in page order, parents first; text blocks have the tag ``#text``. Tolerates any input."""
    nodes = [Node(-1, "#root")]
    open_ = [0]
    buffer: list[str] = []
    link_chars, in_link = 0, False

    def flush() -> None:
        nonlocal link_chars
        text = _SPACES.sub(" ", html.unescape("".join(buffer))).strip()
        buffer.clear()
        if text:
            nodes.append(Node(open_[-1], "#text", nodes[open_[-1]].tag, text, link_chars))
        link_chars = 0

    def close(name: str, stops: tuple[str, ...] = ()) -> None:
        for depth in range(len(open_) - 1, 0, -1):
            tag = nodes[open_[depth]].tag
            if tag == name:
                flush()
                del open_[depth:]
                return
            if tag in stops:
                return

    at, size = 0, len(page)
    lower = None
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            piece = page[at:lt]
            buffer.append(piece)
            link_chars += len(piece) * in_link
        if lt == size:
            break
        m = _TAG.match(page, lt)
        if not m:
            buffer.append("<")
            at = lt + 1
            continue
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                buffer.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        closing = bool(m[1] or m[4])
        if name in RAW and not closing:
            lower = page.lower() if lower is None else lower
            if len(lower) != size:  # a letter whose lower case is longer: search without it
                found = re.compile(rf"</{name}", re.I).search(page, at)
                end = found.start() if found else -1
            else:
                end = lower.find(f"</{name}", at)
            at = size if end < 0 else page.find(">", end) + 1 or size
            if name in ("textarea", "select", "svg", "iframe"):
                buffer.append(" ")
        elif name in BLOCK:
            if closing:
                if name == "p" and not any(nodes[i].tag == "p" for i in open_):
                    flush()
                else:
                    close(name, ("article", "main", "body") if name in ("p", "li") else ())
                continue
            if name in _CLOSES_P:
                close("p", ("td", "th", "li", "div", "article", "section", "main", "body", "blockquote"))
            if name in _SELF_CLOSING:
                inner, stops = _SELF_CLOSING[name]
                for x in inner.split():
                    close(x, stops)
            flush()
            names, mark = "", -1
            for a in _ATTRIBUTE.finditer(m[3] or m[6] or ""):
                key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                if key in ("class", "id", "role", "itemprop", "aria-label"):
                    names += " " + value
                elif key == "data-main":
                    mark = int(value == "1")
            nodes.append(Node(open_[-1], name, names, mark=mark))
            open_.append(len(nodes) - 1)
        elif name == "a":
            in_link = not closing
        elif name in ("br", "hr", "img", "input", "wbr"):
            buffer.append("" if name == "wbr" else " ")
    flush()
    return nodes


def evidence(node: Node) -> list[str]:
    """Names of what is seen at a node."""
    if node.tag != "#text":
        return [f"tag:{node.tag}", *sorted({f"name:{x.lower()}" for x in _NAME_PARTS.findall(node.names) if len(x) > 1})]
    n = len(node.text)
    words = node.text.count(" ") + 1
    return [
        f"in:{node.names}",
        f"links:{round(2 * min(1.0, node.links / n))}",
        f"words:{min(5, words.bit_length())}",
        f"stop:{node.text[-1] in '.!?…。\"”»'}",
        f"sign:{'©' in node.text or '|' in node.text}",
    ]


# -- the model -------------------------------------------------------------------------------------------

#: (feature, label) -> count; edges are features "edge:<parent label>:<kind of child>"
Counts = dict[tuple[str, int], float]

# Labelled pages that come with the operator: data-main marks content (1) or not (0) for all below.
SEED_PAGES = (
    '<body data-main=0><header class="site-header"><p>Daily paper</p><form><label>Search</label></form></header>'
    '<nav class="menu main-nav"><ul><li><a>Home</a></li><li><a>World news</a></li><li><a>Contact</a></li></ul></nav>'
    '<div class="cookie notice banner"><p>We use cookies to improve this site. By going on you accept them.</p></div>'
    '<main data-main=1><article><h1>A title of the story</h1><p>First sentence of the story, long enough to be one.'
    '</p><p>More.</p><h2>A heading</h2><p>Second paragraph with several words in it, and an end.</p><ul><li>One item '
    'of a list in the text</li></ul><blockquote><p>Someone said this.</p></blockquote></article></main>'
    '<aside class="sidebar related" data-main=0><h3>Most read</h3><ul><li><a>Another story</a></li></ul></aside>'
    '<div class="ad advert sponsored promo" data-main=0><p>Buy this now, it is cheap.</p></div>'
    '<section class="comments" id="comments" data-main=0><h3>Comments</h3><div class="comment"><p>I do not agree with '
    'this at all.</p></div><form><label>Your name</label><button>Send</button></form></section>'
    '<footer data-main=0><p>© Daily paper. All rights reserved.</p></footer></body>',
    '<body data-main=0><div id="header" class="top masthead"><ul class="breadcrumb"><li><a>Start</a></li></ul></div>'
    '<div class="wrapper container"><div class="content post entry" data-main=1><h1>Title</h1><p>Text of a post that '
    'goes on for a while and has more than one clause.</p><pre>x = 1</pre><table><tr><td>12</td><td>name of it</td>'
    '</tr></table><p>The end of the post.</p><div class="share social" data-main=0><a>Share</a></div>'
    '<div class="newsletter subscribe signup" data-main=0><p>Sign up for our letter.</p></div></div>'
    '<div class="sidebar widget" data-main=0><div class="ads">Great offer!</div><p>Tags: <a>one</a></p></div></div>'
    '<div id="footer" class="footer legal" data-main=0>© 2020 | <a>Imprint</a> | <a>Privacy</a></div></body>',
    '<body data-main=0><nav><ul><li><a>a</a></li><li><a>b</a></li></ul></nav><div class="ad">One sentence that sells '
    'something to you.</div><article data-main=1><h1>Words of a title</h1><p>A paragraph of running text, long or '
    'short.</p><p>Short.</p><p>And a longer one that does not stop where it should</p></article>'
    '<div class="popup modal consent gdpr" data-main=0><p>Accept all?</p><button>Yes</button></div>'
    '<footer data-main=0>© example · A line of text at the end.</footer></body>',
)


def _kind(tag: str) -> str:
    return "text" if tag == "#text" else "block"


def count_page(nodes: list[Node], labels: list[int], counts: Counter) -> None:
    for i, node in enumerate(nodes):
        if labels[i] < 0:
            continue
        for x in evidence(node):
            counts[x, labels[i]] += 1
        if node.parent >= 0 and labels[node.parent] >= 0:
            counts[f"edge:{labels[node.parent]}:{_kind(node.tag)}", labels[i]] += 1


def marked(nodes: list[Node]) -> list[int]:
    """Labels from data-main marks, inherited by what is below."""
    labels: list[int] = []
    for node in nodes:
        labels.append(node.mark if node.mark >= 0 else labels[node.parent] if node.parent >= 0 else 0)
    return labels


def matched(nodes: list[Node], lines: set[str], first: str) -> list[int]:
    """Labels from a known text: a text block is content if it is one of its lines (or starts its first one);
    an element is content if most of the text below it is."""
    inside, total = [0] * len(nodes), [0] * len(nodes)
    labels = [0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        node = nodes[i]
        if node.tag == "#text":
            total[i] = len(node.text)
            labels[i] = int(node.text in lines or (len(node.text) > 20 and first.startswith(node.text)))
            inside[i] = total[i] * labels[i]
        else:
            labels[i] = int(2 * inside[i] > total[i]) if total[i] else -1
        if node.parent >= 0:
            inside[node.parent] += inside[i]
            total[node.parent] += total[i]
    return labels


def seed_counts() -> Counter:
    counts: Counter = Counter()
    for page in SEED_PAGES:
        nodes = parse(page)
        count_page(nodes, marked(nodes), counts)
    return counts


class Extractor:
    """Potentials from counts, and the inference."""

    def __init__(self, counts: Counts, smooth: float = 0.5):
        self.evidence: dict[str, float] = {}
        totals = Counter()
        for (x, label), n in counts.items():
            totals[x.split(":")[0], label] += n
        for x in {x for x, _ in counts if not x.startswith("edge:")}:
            family = x.split(":")[0]
            p = [(counts.get((x, v), 0) + smooth) / (totals[family, v] + 8 * smooth) for v in (0, 1)]
            # several features of a node say the same thing: each counts half, within bounds
            self.evidence[x] = max(-4.0, min(4.0, 0.5 * math.log(p[1] / p[0])))
        self.edge = {}
        for kind in ("text", "block"):
            for up in (0, 1):
                n = [counts.get((f"edge:{up}:{kind}", v), 0) + smooth for v in (0, 1)]
                self.edge[kind, up] = tuple(math.log(x / sum(n)) for x in n)

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Exact probability of content per node: messages up, then down."""
        size = len(nodes)
        phi = [sum(self.evidence.get(x, 0.0) for x in evidence(n)) for n in nodes]
        up = [[0.0, p] for p in phi]  # evidence at and below a node
        message = [(0.0, 0.0)] * size
        for i in range(size - 1, 0, -1):
            kind, (a, b) = _kind(nodes[i].tag), up[i]
            out = []
            for label in (0, 1):
                e = self.edge[kind, label]
                x, y = e[0] + a, e[1] + b
                hi = x if x > y else y
                out.append(hi + math.log(math.exp(x - hi) + math.exp(y - hi)))
            message[i] = (out[0], out[1])
            parent = up[nodes[i].parent]
            parent[0] += out[0]
            parent[1] += out[1]
        belief = [[0.0, 0.0] for _ in nodes]
        belief[0] = [up[0][0] + math.log(0.9), up[0][1] + math.log(0.1)]
        for i in range(1, size):
            # what the parent believes without this child, sent down
            p, kind = nodes[i].parent, _kind(nodes[i].tag)
            rest = (belief[p][0] - message[i][0], belief[p][1] - message[i][1])
            for label in (0, 1):
                x = rest[0] + self.edge[kind, 0][label]
                y = rest[1] + self.edge[kind, 1][label]
                hi = x if x > y else y
                belief[i][label] = up[i][label] + hi + math.log(math.exp(x - hi) + math.exp(y - hi))
        return [1 / (1 + math.exp(max(-700.0, min(700.0, b[0] - b[1])))) for b in belief]

    def text(self, page: str) -> str:
        nodes = parse(page)
        p = self.marginals(nodes)
        return "\n".join(n.text for n, x in zip(nodes, p, strict=True) if n.tag == "#text" and x > 0.5)


def train(pages: DataFrame, known: DataFrame, features: int = 2_000) -> Counts:
    """Counts from pages (page_id, html) whose text is known (page_id, text), added to the seed pages.

    Pages are labelled and counted on Spark; the ``features`` most frequent features are kept.
    """
    rows = pages.select("page_id", "html").join(known.select("page_id", "text"), "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for page, text in zip(batch.column("html").to_pylist(), batch.column("text").to_pylist(), strict=True):
                lines = [_SPACES.sub(" ", x).strip() for x in (text or "").split("\n")]
                nodes = parse(page or "")
                labels = matched(nodes, {x for x in lines if x}, lines[0])
                if any(x == 1 for x in labels):
                    count_page(nodes, labels, counts)
        keys = list(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
             pa.array([counts[k] for k in keys], pa.int64())],
            names=["feature", "label", "n"],
        )

    found = rows.select("html", "text").mapInArrow(run, "feature string, label int, n long")
    summed = found.groupBy("feature", "label").agg(F.sum("n").alias("n"))
    counts = seed_counts()
    for r in summed.orderBy(F.desc("n"), "feature").limit(2 * features).collect():
        counts[r["feature"], r["label"]] += r["n"]
    return counts


def labelled_pages(pages: DataFrame, docs: DataFrame, rows: int = 2_000) -> tuple[DataFrame, DataFrame]:
    """A bounded sample of pages and the text of the document whose id ends their address, where there is one."""
    named = pages.where("page_id IS NOT NULL AND html IS NOT NULL").select(
        "page_id", F.expr(r"try_cast(regexp_extract(url, '/([0-9]+)(?:[./?#]|$)', 1) AS bigint)").alias("doc_id")
    )
    share = min(1.0, rows / max(1, pages.count()))
    chosen = named.where(F.pmod(F.xxhash64("page_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    chosen = landed(chosen.where("doc_id IS NOT NULL"), "labelled-pages")
    texts = docs.select("doc_id", text_of("text").alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = landed(texts.select("page_id", "text"), "labelled-texts")
    some = landed(pages.select("page_id", "html").join(F.broadcast(chosen.select("page_id")), "page_id"), "labelled-html")
    return some, texts


def main_text(pages: DataFrame, counts: Counts) -> DataFrame:
    """``pages`` with a column ``text``; null, empty and unreadable pages have an empty one, all rows stay."""

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        extractor = Extractor(counts)
        return pa.array([extractor.text(x) if x else "" for x in column.to_pylist()], pa.string())

    return pages.withColumn("text", run(text_of("html")))
