"""Main text of web pages by a graphical model over the tree of blocks.

Every node of a page's tree (``html_tree``) is content or frame. A node has a potential
of its own (a log-linear one of its tag, names, text, links, place), and one with its
parent (a 2 x 2 table for each kind of parent and child). The graph is a tree, so one
pass of sum-product messages up from the leaves and one down from the root give exact
marginals; leaves whose marginal of content is 0.5 or more are the text, in page order.

Both sets of weights are trained together by conditional likelihood, whose gradient is
what is observed less what the marginals of nodes and edges expect. Labelled pages are
the layouts of ``labelled_pages`` and at most ``sample`` pages of the table that label
themselves: one ``article`` and, around it, elements that name themselves frame. Pages
of more than 64 KB are not learned from. The fit is on the driver, bounded by these.

Extraction is one pass without a shuffle; pages of a batch are inferred together, level
by level. A page's cost grows with its length alone, and no length is cut.

Rows: null and empty html, and pages without text, give an empty text of 0 characters.
Repeated ids and equal pages are rows of their own. An empty table gives no rows, and
the layouts alone are learned from. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import labelled_pages
from .html_tree import CHROME, CONTAINERS, PARAGRAPHS, Tree, parse

TAGS = {t: i for i, t in enumerate(sorted(PARAGRAPHS | CONTAINERS | CHROME))}
WORDS = 2048
#: Sizes of the feature groups of an element and of a leaf, in this order.
ELEMENT = {"bias": 1, "tag": len(TAGS), "word": WORDS, "named": 2, "chars": 16, "links": 5, "ends": 3, "leaves": 10, "share": 5, "start": 5, "depth": 8}
LEAF = {"bias": 1, "in": len(TAGS), "chars": 16, "links": 5, "ends": 2, "share": 5, "start": 5, "sign": 2}
SIZE = sum(ELEMENT.values()) + sum(LEAF.values())
KINDS = 7  # of nodes; the table of an edge depends on its two
LONGEST = 1 << 16
CHUNK = 1 << 20


def _offsets(groups: dict[str, int], first: int) -> dict[str, int]:
    found = {}
    for name, size in groups.items():
        found[name], first = first, first + size
    return found


_E, _L = _offsets(ELEMENT, 0), _offsets(LEAF, sum(ELEMENT.values()))
_BUCKET: dict[str, int] = {}


def _word(w: str) -> int:
    if len(_BUCKET) > 100_000:
        _BUCKET.clear()
    return _BUCKET.setdefault(w, zlib.crc32(w.encode()) % WORDS)


def _kind(tag: str, named: bool) -> int:
    """0 leaf, 1 frame element, 2 article or main, 3 and 4 paragraphs, 5 and 6 other
    containers, each without and with a name of its own."""
    if tag == "#text":
        return 0
    if tag in CHROME:
        return 1
    if tag in ("article", "main"):
        return 2
    return (3 if tag in PARAGRAPHS else 5) + named


def _step(x: float, *steps: float) -> int:
    return sum(x > s for s in steps)


@dataclass
class Nodes:
    """Nodes of some pages: parents (-1 for roots), depths, kinds of edges, and features
    as (node, feature) pairs."""

    parent: np.ndarray
    depth: np.ndarray
    edge: np.ndarray
    at: np.ndarray
    feature: np.ndarray


def describe(trees: list[Tree]) -> Nodes:
    parents, depths, edges, at, feature = [], [], [], [], []
    base = 0
    for t in trees:
        n = len(t.tag)
        chars, linked, leaves, ends, depth = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
        start, read = [0] * n, 0
        for i in range(n):
            p = t.parent[i]
            depth[i] = depth[p] + 1 if p >= 0 else 0
            start[i] = read
            text = t.text[i]
            if text is not None:
                chars[i], linked[i], leaves[i] = len(text), t.linked[i], 1
                ends[i] = text[-1] in ".!?…:;”»\"" or text[-2:-1] in (".", "!", "?")
                read += len(text)
        for i in range(n - 1, 0, -1):
            p = t.parent[i]
            chars[p] += chars[i]
            linked[p] += linked[i]
            leaves[p] += leaves[i]
            ends[p] += ends[i]
        whole = max(1, read)
        for i in range(n):
            tag, p = t.tag[i], t.parent[i]
            length, links = min(15, chars[i].bit_length()), _step(linked[i] / max(1, chars[i]), 0, 0.2, 0.5, 0.9)
            share, place = _step(chars[i] / whole, 0.05, 0.2, 0.5, 0.8), _step(start[i] / whole, 0.02, 0.2, 0.8, 0.98)
            if tag == "#text":
                text = t.text[i] or ""
                f = [_L["bias"], _L["in"] + TAGS[t.tag[p]], _L["chars"] + length, _L["links"] + links, _L["ends"] + ends[i], _L["share"] + share, _L["start"] + place, _L["sign"] + ("©" in text)]
            else:
                of = ends[i] / max(1, leaves[i])
                f = [_E["bias"], _E["tag"] + TAGS[tag], _E["named"] + bool(t.words[i]), _E["chars"] + length, _E["links"] + links, _E["ends"] + _step(of, 0, 0.5), _E["leaves"] + min(9, leaves[i].bit_length()), _E["share"] + share, _E["start"] + place, _E["depth"] + min(7, depth[i])]
                f += {_E["word"] + _word(w) for w in t.words[i]}
            feature += f
            at += [base + i] * len(f)
            edges.append(_kind(tag, bool(t.words[i])) * KINDS + _kind(t.tag[p], bool(t.words[p])) if p >= 0 else 0)
            parents.append(base + p if p >= 0 else -1)
        depths += depth
        base += n
    return Nodes(np.array(parents, np.int64), np.array(depths, np.int64), np.array(edges, np.int64), np.array(at, np.int64), np.array(feature, np.int64))


@dataclass(frozen=True)
class Model:
    """``weights`` of features (for content), ``tables`` of edges: [kind, parent, child]."""

    weights: np.ndarray
    tables: np.ndarray


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def propagate(nodes: Nodes, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(marginals of content, marginals [node, parent's state, own state] of the edges to
    parents) by messages up and down."""
    n = len(nodes.parent)
    own = np.zeros((n, 2))
    own[:, 1] = np.bincount(nodes.at, model.weights[nodes.feature], n)
    order = np.argsort(nodes.depth, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(nodes.depth[order])) + 1) if n else []
    up, message = own.copy(), np.zeros((n, 2))
    for rows in levels[:0:-1]:  # from the deepest
        message[rows] = _logsum(model.tables[nodes.edge[rows]] + up[rows][:, None, :], 2)
        np.add.at(up, nodes.parent[rows], message[rows])
    belief, pair = up.copy(), np.zeros((n, 2, 2))
    for rows in levels[1:]:
        rest = belief[nodes.parent[rows]] - message[rows]
        joint = rest[:, :, None] + model.tables[nodes.edge[rows]]
        belief[rows] = up[rows] + _logsum(joint, 1)
        pair[rows] = joint + up[rows][:, None, :]
    belief -= belief.max(1, keepdims=True)
    share = np.exp(belief)
    pair = np.exp(pair - pair.max((1, 2), keepdims=True))
    return share[:, 1] / share.sum(1), pair / pair.sum((1, 2), keepdims=True)


def node_labels(tree: Tree, content: list[bool]) -> np.ndarray:
    """Labels of all nodes from those of leaves: an element is what most of its text is."""
    score = np.zeros(len(tree.tag))
    for i in range(len(tree.tag) - 1, -1, -1):
        text = tree.text[i]
        if text is not None:
            score[i] = len(text) if content[i] else -len(text)
        if tree.parent[i] >= 0:
            score[tree.parent[i]] += score[i]
    return (score > 0).astype(np.int64)


def train(trees: list[Tree], labels: list[np.ndarray], steps: int = 200, ridge: float = 0.02) -> Model:
    """Weights and tables of greatest penalised likelihood, by full-batch Adam steps."""
    nodes, y = describe(trees), np.concatenate(labels) if labels else np.zeros(0, np.int64)
    child = np.flatnonzero(nodes.parent >= 0)
    seen = np.zeros((KINDS * KINDS, 2, 2))
    np.add.at(seen, (nodes.edge[child], y[nodes.parent[child]], y[child]), 1)
    told = np.bincount(nodes.feature, y[nodes.at], SIZE)
    theta = [np.zeros(SIZE), np.zeros((KINDS * KINDS, 2, 2))]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for k in range(1, steps + 1):
        p, pair = propagate(nodes, Model(*theta))
        expected = np.zeros_like(seen)
        np.add.at(expected, nodes.edge[child], pair[child])
        gradient = [told - np.bincount(nodes.feature, p[nodes.at], SIZE) - ridge * theta[0], seen - expected - ridge * theta[1]]
        rate = 0.1 / (1 + k / 100)
        for i, g in enumerate(gradient):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            theta[i] = theta[i] + rate * (first[i] / (1 - 0.9**k)) / (np.sqrt(second[i] / (1 - 0.999**k)) + 1e-8)
    return Model(*theta)


def hand_labelled(of_each: int = 24) -> tuple[list[Tree], list[np.ndarray]]:
    trees, labels = [], []
    for page in labelled_pages.pages(of_each):
        tree = parse(page)
        content = [t is not None and labelled_pages.MARK in t for t in tree.text]
        tree.text = [t if t is None else t.replace(labelled_pages.MARK, "") for t in tree.text]
        trees.append(tree)
        labels.append(node_labels(tree, content))
    return trees, labels


def self_labelled(tree: Tree) -> np.ndarray | None:
    """Labels of a page by its own elements, or None if they don't tell: it has one
    ``article``, and in it nothing that is named or a frame element."""
    if tree.tag.count("article") != 1:
        return None
    top, n = tree.tag.index("article"), len(tree.tag)
    inside = [False] * n
    for i in range(top, n):
        inside[i] = i == top or (tree.parent[i] >= 0 and inside[tree.parent[i]])
        if inside[i] and i > top and (tree.tag[i] in CHROME or tree.words[i]):
            return None
    return node_labels(tree, inside)


def fit(pages: DataFrame | None = None, sample: int = 256, id_column: str = "page_id") -> Model:
    """A model from the layouts and at most ``sample`` pages that label themselves."""
    trees, labels = hand_labelled()
    if pages is not None and sample:
        some = pages.where(F.col("html").contains("<article") & (F.octet_length("html") <= LONGEST)).select(F.col(id_column).alias("_id"), "html")
        # ids alone are ordered, since every task sends its first ones to the driver
        ids = some.where("_id is not null").select("_id").orderBy(F.xxhash64("_id"), "_id").limit(sample).distinct()
        for r in some.join(F.broadcast(ids), "_id").groupBy("_id").agg(F.min("html").alias("html")).orderBy("_id").collect():
            tree = parse(r.html)
            marks = self_labelled(tree)
            if marks is not None:
                trees.append(tree)
                labels.append(marks)
    return train(trees, labels)


def texts(pages: list[str | None], model: Model) -> list[str]:
    """The main text of each page."""
    trees = [parse(p or "") for p in pages]
    if not trees:
        return []
    content, out, base = propagate(describe(trees), model)[0] >= 0.5, [], 0
    for t in trees:
        out.append("\n".join(x for i, x in enumerate(t.text) if x is not None and content[base + i]))
        base += len(t.tag)
    return out


def extract(pages: DataFrame, model: Model, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, text and n_chars of every row of ``pages`` (html)."""
    source = pages.select(*keep, F.col("html"))
    schema = StructType([*source.schema.fields[:-1], StructField("text", StringType()), StructField("n_chars", LongType())])
    last = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages, first = batch.column(last).to_pylist(), 0
            while first < len(pages):
                end, size = first, 0
                while end < len(pages) and (end == first or size < CHUNK):
                    size += len(pages[end] or "")
                    end += 1
                found = texts(pages[first:end], model)
                kept = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([*kept.columns[:last], pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], schema.fieldNames())
                first = end

    return source.mapInArrow(run, schema)
