"""Main text of web pages by a tree-structured graphical model over the DOM.

Block elements and the runs of text directly inside them are nodes of a tree.
Every node has a hidden label, content or not; a node's features (tag, class
words, length, links, marks) are its own potential, and a parent-child potential
connects neighbours.  Sum-product messages run up from the leaves and down from
the root; a run of text is main text if its marginal is above one half.

Potentials are smoothed counts from labelled pages.  These are made from a bounded
sample of the given pages (``TRAINING_PAGES``, by hash of id and url): the article's
paragraphs and the short texts around it are set into page layouts in which each
section's label is known.  Everything else looks at whole pages, one by one, in
tasks of a few megabytes; no page meets another, so skew cannot arise.

Defined results: a null or empty page has an empty text; unclosed, misnested or cut
markup is read as far as it goes; repeated rows are extracted each; ids and urls
may be null; further columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import prepare, query, table

TRAINING_PAGES = 200
# A few samples are set into more layouts each, up to this number together.
LEAST_LAYOUTS = 60
# Features of one node depend on each other; no single one may weigh more.
LEAF_WEIGHT, ELEMENT_WEIGHT = 2.0, 4.0

# Element kinds of HTML.
BLOCKS = frozenset(
    "html body main article section nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption "
    "thead tbody tfoot tr td th blockquote pre figure figcaption address form fieldset legend details summary hgroup "
    "center dialog menu search hr".split()
)
SKIPPED = frozenset(
    "head script style noscript template svg math iframe object select button textarea canvas audio video title".split()
)
RAW = frozenset("script style textarea title iframe noscript".split())
IN_HEAD = frozenset("title meta link base script style noscript template".split())
CLOSED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
}
SCOPES = frozenset(["ul", "ol", "dl", "table", "html", "body", "menu"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+[^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
WORD = re.compile(r"[a-z]+")


@dataclass
class Node:
    parent: int
    tag: str
    marks: tuple[str, ...] = ()
    text: str | None = None  # of a run of text; None for an element
    linked: int = 0
    label: int | None = None


@dataclass
class _Run:
    pieces: list[str] = field(default_factory=list)
    linked: int = 0


def _marks(attributes: str, labelled: bool) -> tuple[tuple[str, ...], int | None]:
    found, label = [], None
    for name, value in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in ("class", "id", "role"):
            found += WORD.findall(value.lower())
        elif labelled and name == "data-label":
            label = int(value.strip("\"'"))
    return tuple(dict.fromkeys(found)), label


def parse(html: str, labelled: bool = False) -> list[Node]:
    """The block tree of a page, parents before children, in page order.

    Only pages built for training are ``labelled``; elsewhere no attribute is a label.  The
    head ends at the first element that belongs to a body, and an element that is passed
    over ends with the block around it, should its own end be missing.
    """
    nodes, stack, run = [Node(-1, "root")], [0], _Run()
    links = skipping = 0
    skipped = ""
    inside: Counter = Counter()

    def close_run() -> None:
        nonlocal run
        text = " ".join("".join(run.pieces).split())
        if text:
            nodes.append(Node(stack[-1], "#text", (), text, run.linked))
        run = _Run()

    def add(text: str) -> None:
        if text and not skipping:
            text = unescape(text)
            run.pieces.append(text)
            run.linked += len(text.split()) * (links > 0)

    at, end = 0, len(html)
    while at < end:
        token = TOKEN.search(html, at)
        if token is None:
            add(html[at:])
            break
        add(html[at : token.start()])
        at = token.end()
        if token[2] is None:
            continue
        tag, closing = token[2].lower(), token[1] == "/"
        if skipping:
            if tag == skipped:
                skipping += -1 if closing else tag not in VOID and not token[3].endswith("/")
            elif skipped == "head":
                if tag not in IN_HEAD and not closing:
                    skipping = 0
                elif not closing and (tag in RAW or tag == "template"):
                    stop = re.compile(f"</{tag}", re.I).search(html, at)
                    at = stop.start() if stop else end
            elif tag in BLOCKS:
                if not closing:
                    inside[tag] += 1
                elif inside[tag]:
                    inside[tag] -= 1
                elif any(nodes[i].tag == tag for i in stack[1:]):
                    skipping = 0
            if skipping:
                continue
        if tag in SKIPPED:
            if not closing and not token[3].endswith("/"):
                if tag in RAW:
                    stop = re.compile(f"</{tag}", re.I).search(html, at)
                    at = stop.start() if stop else end
                skipping, skipped = 1, tag
                inside.clear()
            continue
        if tag == "a":
            links = 0 if closing else 1
        elif tag in ("br", "wbr", "img", "input", "label", "option") and tag != "wbr":
            run.pieces.append(" ")
        if tag not in BLOCKS:
            continue
        close_run()
        if closing:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if nodes[stack[i]].tag == tag), 0)
            if depth:
                del stack[depth:]
            continue
        if nodes[stack[-1]].tag == "p":
            stack.pop()
        if tag in CLOSED_BY:
            for i in range(len(stack) - 1, 0, -1):
                own = nodes[stack[i]].tag
                if own in CLOSED_BY[tag]:
                    del stack[i:]
                    break
                if own in SCOPES:
                    break
        if tag == "hr":
            continue
        marks, label = _marks(token[3], labelled)
        nodes.append(Node(stack[-1], tag, marks, label=label))
        stack.append(len(nodes) - 1)
    close_run()
    return nodes


def features(nodes: list[Node], i: int) -> list[str]:
    node = nodes[i]
    if node.text is None:
        return [f"tag {node.tag}", *[f"mark {m}" for m in node.marks]]
    words = len(node.text.split())
    linked = node.linked / max(1, words)
    return [
        f"in {nodes[node.parent].tag}",
        f"words {0 if words < 3 else 1 if words < 8 else 2 if words < 25 else 3}",
        f"linked {0 if linked == 0 else 1 if linked < 0.5 else 2}",
        f"ends {node.text[-1] in '.!?…»”\"'}",
        *(["sign"] if "©" in node.text else []),
    ]


@dataclass
class Model:
    """``own``: log-odds of a feature; ``links[kind][parent label][label]``: log-probabilities; ``root``: a prior."""

    own: dict[str, float]
    links: list[list[list[float]]]
    root: list[float]


def kind_of(nodes: list[Node], node: Node) -> int:
    """Which potential connects a node with its parent: page frame or section, element or run of text."""
    return 2 * (nodes[node.parent].tag in ("root", "html", "body")) + (node.text is not None)


def labels_of(nodes: list[Node]) -> list[int]:
    """Labels of a labelled page: of a run that of the nearest marked element, of an element whether it holds content."""
    near, out = [0] * len(nodes), [0] * len(nodes)
    for i, node in enumerate(nodes):
        near[i] = node.label if node.label is not None else near[node.parent] if i else 0
    for i in range(len(nodes) - 1, -1, -1):
        if nodes[i].text is not None:
            out[i] = near[i]
        if i and out[i]:
            out[nodes[i].parent] = 1
    return out


def train(pages: list[str]) -> Model:
    """Smoothed counts over labelled pages."""
    seen = [Counter(), Counter()]
    total = {(leaf, y): 0 for leaf in (False, True) for y in (0, 1)}
    moves = [[[0.5, 0.5], [0.5, 0.5]] for _ in range(4)]
    leaf_feature: dict[str, bool] = {}
    for html in pages:
        nodes = parse(html, labelled=True)
        labels = labels_of(nodes)
        for i in range(1, len(nodes)):
            leaf = nodes[i].text is not None
            total[leaf, labels[i]] += 1
            moves[kind_of(nodes, nodes[i])][labels[nodes[i].parent]][labels[i]] += 1
            for f in features(nodes, i):
                seen[labels[i]][f] += 1
                leaf_feature[f] = leaf
    own = {}
    for f, leaf in leaf_feature.items():
        rate = [(seen[y][f] + 0.5) / (total[leaf, y] + 1.0) for y in (0, 1)]
        most = LEAF_WEIGHT if leaf else ELEMENT_WEIGHT
        own[f] = max(-most, min(most, math.log(rate[1] / rate[0])))
    links = [[[math.log(x / sum(row)) for x in row] for row in rows] for rows in moves]
    return Model(own, links, [math.log(0.05), math.log(0.95)])


def _both(a: float, b: float) -> float:
    top = a if a > b else b
    return top + math.log(math.exp(a - top) + math.exp(b - top))


def marginals(nodes: list[Node], model: Model) -> list[float]:
    """The probability of content of every node."""
    n, get = len(nodes), model.own.get
    up = [[0.0, 0.0] for _ in range(n)]
    sent = [(0.0, 0.0)] * n
    for i in range(n - 1, 0, -1):
        node = nodes[i]
        b0, b1 = up[i]
        b1 += sum([get(f, 0.0) for f in features(nodes, i)])
        up[i] = [b0, b1]
        link = model.links[kind_of(nodes, node)]
        m0, m1 = _both(link[0][0] + b0, link[0][1] + b1), _both(link[1][0] + b0, link[1][1] + b1)
        sent[i] = (m0, m1)
        above = up[node.parent]
        above[0] += m0
        above[1] += m1
    belief = [(0.0, 0.0)] * n
    belief[0] = (model.root[0] + up[0][0], model.root[1] + up[0][1])
    out = [0.0] * n
    for i in range(n):
        if i:
            p0, p1 = belief[nodes[i].parent]
            c0, c1 = p0 - sent[i][0], p1 - sent[i][1]
            link = model.links[kind_of(nodes, nodes[i])]
            belief[i] = (
                up[i][0] + _both(c0 + link[0][0], c1 + link[1][0]),
                up[i][1] + _both(c0 + link[0][1], c1 + link[1][1]),
            )
        b0, b1 = belief[i]
        out[i] = math.exp(b1 - _both(b0, b1))
    return out


def main_text(html: str | None, model: Model) -> str:
    """The runs of text that are content, in page order."""
    if not html:
        return ""
    nodes = parse(html)
    share = marginals(nodes, model)
    return "\n\n".join(n.text for n, p in zip(nodes, share) if n.text is not None and p > 0.5)


# Names under which pages keep their main text, and other sections.
CONTENT_NAMES = "content article post entry story main body text page read prose blog news".split()
OTHER_NAMES = (
    "ad ads advert advertisement sponsor sponsored promo banner cookie cookies consent notice alert gdpr menu nav navbar "
    "navigation breadcrumb breadcrumbs sidebar widget related recommended popular share social follow newsletter "
    "subscribe signup login search comment comments reply replies respond disqus footer copyright legal header masthead "
    "topbar toolbar logo pagination pager tags author bio popup modal overlay"
).split()

# What a sample without an article, or without short texts around it, is filled up with.
PLAIN_PROSE = [
    "A walk along the river",
    "The path begins at the old bridge and follows the water for about an hour, past two mills, a row of poplars and "
    "a meadow that is under water in most winters.",
    "It is easy to walk. Good shoes help after rain, when the lower part is soft and the stones are slippery.",
    "Halfway there is a bench, and from it one sees the whole valley, the church on the other side and, on clear "
    "days, the first of the mountains behind it.",
    "Nobody knows who put it there.",
]
PLAIN_SHORT = ["Home", "About us", "Contact", "Search", "More to read", "Terms of use", "Log in", "Next page", "Help"]


def training_pages(samples: list[str]) -> list[str]:
    """Labelled pages: the texts of each sample set into layouts with known sections.

    A sample that lacks an article or short texts gets fixed ones, so every sample gives layouts.
    """
    out = []
    turns = max(3, -(-LEAST_LAYOUTS // max(1, len(samples))))
    for k, html in enumerate(samples):
        nodes = parse(html)
        inside = [False] * len(nodes)
        for i, n in enumerate(nodes):
            inside[i] = i > 0 and (inside[n.parent] or n.tag in ("article", "main"))
        runs = [i for i, n in enumerate(nodes) if n.text is not None]
        prose = [nodes[i].text for i in runs if inside[i]]
        prose = prose or [nodes[i].text for i in runs if len(nodes[i].text.split()) > 20 and not nodes[i].linked]
        short = [nodes[i].text for i in runs if not inside[i] and len(nodes[i].text.split()) <= 20]
        for turn in range(turns):
            out.append(_layout(turns * k + turn, prose or PLAIN_PROSE, short or PLAIN_SHORT))
    return out


def _layout(k: int, prose: list[str], short: list[str]) -> str:
    def safe(text: str) -> str:
        return text.replace("&", "&amp;").replace("<", "&lt;")

    def words(i: int) -> str:
        return safe(short[i % len(short)])

    def links(i: int) -> str:
        items = "".join(f'<li><a href="/{j}">{words(i + j)}</a></li>' for j in range(5))
        return f"<ul>{items}</ul>"

    def remark(i: int) -> str:
        said = safe(" ".join(prose[i % len(prose)].split()[: 8 + i % 23]))
        return said if said.endswith(".") else said + "."

    def section(i: int) -> str:
        name = OTHER_NAMES[(7 * k + i) % len(OTHER_NAMES)]
        mark = f'class="{name}"' if (k + i) % 3 else f'id="{name}"'
        h = ("h2", "h3", "h4")[(k + i) % 3]
        kinds = [
            f"<div {mark} data-label=0>{remark(i)}</div>",
            f"<div {mark} data-label=0>{links(i)}</div>",
            f"<aside {mark} data-label=0><{h}>{words(i)}</{h}>{links(i)}<p>{remark(i)}</p></aside>",
            f"<section {mark} data-label=0><{h}>{words(i)}</{h}><div {mark}><p>{remark(i)}</p></div>"
            f"<div {mark}><p>{remark(i + 1)}</p></div></section>",
            f"<form {mark} data-label=0><p>{words(i)}</p><label>{words(i + 1)}</label><input></form>",
            f"<aside data-label=0><p>{remark(i)}</p></aside>",
            f'<ol class="{name}" data-label=0><li><p>{remark(i)}</p></li><li><p>{remark(i + 2)}</p></li></ol>',
        ]
        return kinds[(k + 3 * i) % len(kinds)]

    name = CONTENT_NAMES[k % len(CONTENT_NAMES)]
    first, *rest = prose
    paragraphs = [f"<p>{safe(t)}</p>" for t in rest]
    for i in range(k % 4):
        paragraphs.insert((5 * i + k) % (len(paragraphs) + 1), f"<p>{remark(i).split()[0]}{'.!,'[k % 3]}</p>")
    if k % 4 == 1 and len(rest) > 2:
        h = ("h2", "h3", "h4")[k % 3]
        paragraphs[1] = f"<{h}>{safe(' '.join(rest[1].split()[: 1 + k % 6]))}</{h}>{paragraphs[1]}"
    if k % 4 == 2 and len(rest) > 2:
        paragraphs[1] = f"<ul><li>{safe(rest[1])}</li><li>{remark(1)}</li></ul><blockquote>{paragraphs[2]}</blockquote>"
    if k % 5 == 3:
        paragraphs.insert(len(paragraphs) // 2, section(9))
    body = f"<h1>{safe(' '.join(first.split()[:9]))}</h1>" + "".join(paragraphs)
    holder = [
        f"<article data-label=1>{body}</article>",
        f'<main data-label=1><div class="{name}">{body}</div></main>',
        f'<div class="{name}" data-label=1>{body}</div>',
        f'<div id="{name}" data-label=1><article>{body}</article></div>',
        f'<section class="{name}" data-label=1>{body}</section>',
    ][k % 5]
    top = f"<nav data-label=0>{links(k)}</nav>" if k % 2 else f"<header data-label=0><p>{words(k)}</p>{links(k)}</header>"
    foot = f"<footer data-label=0>&copy; {words(k)} &middot; {remark(k)}</footer>"
    return f"<html><body>{top}{section(0)}{holder}{section(1)}{section(2)}{foot}</body></html>"


def fit(pages: DataFrame, id_col: str, url_col: str, html_col: str, sample: int = TRAINING_PAGES) -> Model:
    """Potentials from a bounded sample of the pages; only so many pages come to the driver."""
    mark = F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{url_col}`"))
    rows = pages.select(mark.alias("mark"), F.col(f"`{html_col}`").alias("html")).where("html != ''")
    picked = rows.select("mark", F.length("html").alias("size")).orderBy("mark", "size").limit(sample)
    edge = picked.agg(F.max("mark")).first()[0]
    if edge is None:
        return Model({}, [[[math.log(0.5)] * 2] * 2] * 4, [math.log(0.5)] * 2)
    texts = rows.where(F.col("mark") <= edge).orderBy("mark", F.length("html")).limit(sample).collect()
    return train(training_pages([r["html"] for r in texts]))


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Model | None = None
) -> DataFrame:
    """(page_id, url, text, n_chars) per row."""
    spark = pages.sparkSession
    prepare(spark)
    held = spark.sparkContext.broadcast(model or fit(pages, id_col, url_col, html_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(h.as_py(), held.value) for h in part.column(2)]
                found = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *found], names=["page_id", "url", "text", "n_chars"]
                )

    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html")
    )
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


@query("op2_html_extraction")
def op2_html_extraction(spark, folder):
    return extract(table(spark, folder, "pages"))
