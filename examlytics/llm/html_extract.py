"""Main text of web pages by minimum-cut labelling.

A page becomes blocks (the text between block-level tags).  A linear classifier gives each block the
log odds of being content from its ancestors, the words of their class, id and role, link density, length and sentence marks.
Positive odds are the capacity from the source to the block, negative ones
the capacity from the block to the sink.  Neighbouring blocks, and consecutive blocks of the same
parent, are joined by edges whose capacity grows with the part of their ancestors that they share.
A maximum flow (Dinic) then separates content from boilerplate at least total cost: a block
is relabelled against its own odds only where its surroundings outweigh them.

The classifier is a logistic regression.  ``pages`` has no labels, so it learns from blocks that the markup labels
(inside article or main; inside navigation, footers, forms, adverts) on a bounded sample of pages, around the listed
prior weights; a sample without such markup leaves the prior as it is.

Text: character references are decoded, white space within a block becomes one space, blocks are
trimmed and joined in page order by an empty line.  Scripts, styles, comments, hidden elements and the head are no blocks;
the head ends at the first element or text that cannot be in it.

Names: a class, id or role speaks of boilerplate by its parts (``cookie-notice``), but not behind a part that makes it a
state or a subject (``has-sidebar``, ``tag-social``) and not as a layout (``content-sidebar-wrap``).  Inside an article or
main only the containers below the outermost one are judged, articles themselves only as comments, and headers not at all.

Defined cases: null or empty html and pages without content give the empty text.  Unclosed tags,
quotes and comments run to the end of the page.  Repeated rows get a row each.  Pages of any length
are read whole; ``label_pages`` also returns every block with its label.  Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .html_blocks import Block, Node, Page, read

#: Features of a block and the classifier's prior weights, in log odds.
PRIOR = {"bias": -0.4, "in_main": 5.0, "in_boilerplate": -9.0, "named_main": 2.0, "named_boilerplate": -9.0, "linked": -4.0,
         "heading_1": 1.5, "log_length": 0.35, "sentence": 0.8}
#: Pages and blocks of a page that training looks at (a bounded sample of labelled rows).
TRAIN_PAGES = 1000
TRAIN_BLOCKS = 60
#: Weight of the sample against the prior (variance 1).
TRAIN_WEIGHT = 200.0
#: Capacity of an edge between blocks that share all ancestors.
SMOOTH = 2.5
#: Log odds become integer capacities in these steps.
SCALE = 100

_MAIN = frozenset(("article", "main"))
_BOILERPLATE = frozenset("nav footer aside form header menu dialog button fieldset legend".split())
_MAIN_NAMES = re.compile(r"(?:^|[\s_-])(?:article|content|main|post|entry|story|body)(?:$|[\s_-])")
_BOILERPLATE_NAMES = re.compile(
    r"(?:nav|navbar|navigation|menu|breadcrumbs?|header|masthead|banner|footer|contentinfo|sidebar|side|aside|complementary|"
    r"ads?|advert\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|search|"
    r"share|sharing|social|related|recommended|widget|toolbar|pagination|pager|tags|comments?|disqus|replies|reply|respond|"
    r"copyright|legal|skip|form|dialog)(?:\d.*)?")
_PARTS = re.compile(r"[_-]+")
#: What stands behind one of these parts of a name is a state or a subject, not the container's kind.
_SAFE = frozenset("has no with without is not show hide hidden cat category categories tag topic term type format status layout".split())
_WRAPS = frozenset("container grid inner wrap wrapper".split())
_WRAPPED = frozenset("article content entry layout main page post site story".split())


def _ancestors(node: Node | None) -> list[Node]:
    out = []
    while node is not None and node.tag:
        out.append(node)
        node = node.parent
    return out[::-1]


@lru_cache(maxsize=1 << 14)
def boilerplate_names(names: str) -> frozenset[str]:
    """The parts of a container's names that speak of boilerplate."""
    out = set()
    for name in names.split():
        parts = [p for p in _PARTS.split(name) if p]
        if not parts or parts[-1] == "layout" or (parts[-1] in _WRAPS and parts[0] in _WRAPPED):
            continue
        for part in parts:
            if part in _SAFE:
                break
            if _BOILERPLATE_NAMES.fullmatch(part):
                out.add(part)
    return frozenset(out)


def _named_boilerplate(chain: list[Node]) -> bool:
    top = next((i for i, n in enumerate(chain) if n.tag in _MAIN), -1)
    for i, n in enumerate(chain):
        if i <= top or not n.names or n.tag in ("html", "body"):
            continue
        found = boilerplate_names(n.names)
        if n.tag in _MAIN:
            found = found & {"comment", "comments"}
        elif top >= 0:
            found = found - {"header"}
        if found:
            return True
    return False


def features(block: Block, known: dict[int, tuple]) -> list[float]:
    """In the order of PRIOR.  ``known`` remembers what a container and its ancestors give."""
    if id(block.node) not in known:
        chain = _ancestors(block.node)
        main_at = max((i for i, n in enumerate(chain) if n.tag in _MAIN), default=-1)
        bad = any(n.tag in _BOILERPLATE and not (n.tag == "header" and i > main_at >= 0) for i, n in enumerate(chain))
        bad_name = _named_boilerplate(chain)
        main_name = any(n.names and _MAIN_NAMES.search(n.names) for n in chain)
        known[id(block.node)] = (1.0, float(main_at >= 0), float(bad), float(main_name), float(bad_name)), float(any(n.tag == "h1" for n in chain))
    place, heading = known[id(block.node)]
    n = len(block.text)
    return [*place, min(1.0, block.linked / n), heading, math.log(n / 20), float(block.text[-1] in ".!?…。:;\"'”»")]


def taught(x: list[float]) -> float | None:
    """The label that a block's markup gives: 1 inside article or main, 0 inside boilerplate, None where it says nothing."""
    _, main, bad, _, bad_name, *_ = x
    return 0.0 if bad or bad_name else 1.0 if main else None


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression around PRIOR (Newton steps)."""
    prior = np.array(list(PRIOR.values()))
    w = prior.copy()
    if not len(y):
        return w
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = TRAIN_WEIGHT * x.T @ (p - y) / len(y) + (w - prior)
        curve = TRAIN_WEIGHT * (x.T * (p * (1 - p))) @ x / len(y) + np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> np.ndarray:
    """Weights learned from TRAIN_PAGES pages (the first by a hash of the id).

    Markup labels the blocks; each is taught twice, with its markup and without it, so that the text's
    own features learn to decide where a page has no telling elements."""
    some = (pages.select(F.xxhash64(id_col).alias("__h"), F.col(html_col).alias("__html")).orderBy("__h").limit(TRAIN_PAGES))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs = []
            for text in batch.column("__html").to_pylist():
                blocks = read(text or "").blocks
                known: dict[int, tuple] = {}
                xs.extend(x for x in (features(b, known) for b in blocks[::max(1, len(blocks) // TRAIN_BLOCKS)][:TRAIN_BLOCKS]) if taught(x) is not None)
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.list_(pa.float64()))], names=["x"])

    found = map_batches(some.select("__html"), rows, "x array<double>").toArrow().column("x").to_pylist()  # TRAIN_PAGES x TRAIN_BLOCKS at most
    x = np.array(found, float).reshape(-1, len(PRIOR))
    y = np.array([taught(r) for r in found], float)
    bare = x.copy()
    bare[:, 1:5] = 0
    return fit(np.concatenate([x, bare]), np.concatenate([y, y]))


def closeness(a: Node, b: Node) -> float:
    """Share of the longer chain of ancestors that two containers have in common."""
    depth = max(a.depth, b.depth, 1)
    while a.depth > b.depth:
        a = a.parent
    while b.depth > a.depth:
        b = b.parent
    while a is not b:
        a, b = a.parent, b.parent
    return (a.depth + 1) / (depth + 1)


def min_cut(unary: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes stay with the source: ``unary`` > 0 is the capacity from it, < 0 to the sink; ``edges``
    (a, b, capacity) run both ways.  Dinic's algorithm."""
    n = len(unary)
    if all(u >= 0 for u in unary):
        return [True] * n
    if all(u <= 0 for u in unary):
        return [False] * n
    s, t = n, n + 1
    to: list[int] = []
    cap: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def add(a: int, b: int, forth: int, back: int) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(forth)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, u in enumerate(unary):
        if u > 0:
            add(s, i, u, 0)
        elif u < 0:
            add(i, t, -u, 0)
    for a, b, c in edges:
        add(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        line = [s]
        for v in line:
            for e in out[v]:
                if cap[e] and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    line.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        nexts = [0] * (n + 2)
        path: list[int] = []
        v = s
        while True:
            if v == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                first = next(i for i, e in enumerate(path) if not cap[e])
                v = to[path[first] ^ 1]
                del path[first:]
                continue
            while nexts[v] < len(out[v]):
                e = out[v][nexts[v]]
                if cap[e] and level[to[e]] == level[v] + 1:
                    path.append(e)
                    v = to[e]
                    break
                nexts[v] += 1
            else:
                if v == s:
                    break
                level[v] = -1
                v = to[path.pop() ^ 1]


def label(page: Page, weights=None) -> list[bool]:
    """Whether each block of a page is content."""
    blocks = page.blocks
    known: dict[int, tuple] = {}
    w = list(PRIOR.values()) if weights is None else [float(v) for v in weights]
    unary = [round(SCALE * sum(a * b for a, b in zip(w, features(block, known)))) for block in blocks]
    edges, last = [], {}
    for i, b in enumerate(blocks):
        near = {i - 1} if i else set()
        parent = id(b.node.parent)
        if parent in last:
            near.add(last[parent])
        last[parent] = i
        for j in near:
            edges.append((j, i, round(SCALE * SMOOTH * closeness(blocks[j].node, b.node) ** 2 / 2)))
    return min_cut(unary, edges)


def extract(html: str, weights=None) -> str:
    page = read(html)
    return "\n\n".join(b.text for b, keep in zip(page.blocks, label(page, weights)) if keep)


def label_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", weights=None) -> DataFrame:
    """(id, block, text, content): every block of every page with its label."""
    src = pages.select(F.col(id_col).alias("__id"), F.col(html_col).alias("__html"))
    kind = src.schema["__id"].dataType.simpleString()

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column("__html").to_pylist()):
                page = read(text or "")
                keep = label(page, weights)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("__id").take(pa.array([i] * len(keep), pa.int64())), pa.array(range(len(keep)), pa.int32()),
                     pa.array([b.text for b in page.blocks], pa.string()), pa.array(keep, pa.bool_())], names=["__id", "block", "text", "content"])

    return map_batches(src, labelled, f"__id {kind}, block int, text string, content boolean").withColumnRenamed("__id", id_col)


def main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", weights=None) -> DataFrame:
    """One row per page: id, url, text, n_chars."""
    src = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"), F.col(html_col).alias("__html"))
    kinds = {f.name: f.dataType.simpleString() for f in src.schema}

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 500):
                batch = whole.slice(at, 500)
                texts = [extract(h or "", weights) for h in batch.column("__html").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__url"), pa.array(texts, pa.string()),
                                                  pa.array([len(t) for t in texts], pa.int64())], names=["__id", "__url", "text", "n_chars"])

    out = map_batches(src, extracted, f"__id {kinds['__id']}, __url {kinds['__url']}, text string, n_chars bigint")
    return out.withColumnsRenamed({"__id": id_col, "__url": url_col})


def op8_html_extract(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return main_text(pages, weights=train(pages))
