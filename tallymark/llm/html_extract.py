"""Main text of HTML pages by a tree-structured graphical model over DOM nodes.

Every block-level element is a node with a state, content or not. Its own potential comes from its
tag, the names in its class, id and role, its text and its links; a 2 x 2 potential ties it to its
parent. Sum-product messages run from the leaves to the root and back and give exact marginals.
The potentials are fitted on labelled pages by the likelihood of the labels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallymark.llm.common import chunks, free_names
from tallymark.llm.html_pages import NAMES, labelled_pages

# Fixed values of HTML: elements without content, of raw text, and elements that flow inside a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript svg math template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
UNSEEN = frozenset("html head body p li dt dd tr td th thead tbody tfoot option".split())
#: An open element that a new one ends: (which are ended, where the search stops).
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"})}
KINDS = {**{h: "heading" for h in ("h1", "h2", "h3", "h4", "h5", "h6")}, "ul": "list", "ol": "list", "dl": "list", "menu": "list", "dt": "li", "dd": "li", "li": "li",
         **{t: "table" for t in ("table", "tr", "td", "th", "thead", "tbody", "tfoot", "caption")}, "blockquote": "quote", "pre": "quote", "figure": "figure", "figcaption": "figure", "picture": "figure",
         **{t: "form" for t in ("form", "fieldset", "legend", "label", "button", "select", "option", "output", "datalist", "dialog")},
         **{t: t for t in ("article", "main", "section", "div", "p", "nav", "header", "footer", "aside", "body", "html", "head", "address", "center", "details", "summary", "hgroup")}}
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|data-keep|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I | re.S)
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")
_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}
_OWN = {part: role for role, names in NAMES.items() for name in names for part in [name] if "-" not in name}


@dataclass
class Tree:
    """Nodes in document order; a parent comes before its children."""

    kind: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    chars: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    last: list[str] = field(default_factory=list)
    keep: list[str | None] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)

    def add(self, tag: str, attributes: str, parent: int) -> int:
        names, keep = "", None
        if attributes:
            for key, *values in _ATTRIBUTE.findall(attributes):
                value = "".join(values)
                if key.lower() == "data-keep":
                    keep = value
                else:
                    names += " " + (value if key.lower() != "hidden" else "hidden")
        for column, value in zip((self.kind, self.names, self.parent, self.chars, self.linked, self.last, self.keep), (KINDS.get(tag, "other"), names, parent, 0, 0, "", keep)):
            column.append(value)
        return len(self.kind) - 1


def parse(html: str) -> Tree:
    """Nodes and blocks of a page. Broken markup is read the way browsers do: elements left open end
    with their parent or where a sibling must end them, stray end tags count for nothing."""
    tree = Tree()
    stack, at, link, parts, linked = [("", tree.add("html", "", -1))], 0, False, [], 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                node = stack[-1][1]
                tree.blocks.append((node, text))
                tree.chars[node] += len(text)
                tree.linked[node] += min(linked, len(text))
                tree.last[node] = text[-1]
            parts, linked = [], 0

    def said(text: str) -> None:
        nonlocal linked
        text = unescape(text) if "&" in text else text
        parts.append(text)
        if link:
            linked += len(text)

    while True:
        tag = _TAG.search(html, at)
        if tag is None:
            if at < len(html):
                said(html[at:])
            break
        if tag.start() > at:
            said(html[at:tag.start()])
        at = tag.end()
        end, name, attributes, odd, odd_attributes = tag.groups()
        if end:
            end = end.lower()
            if end == "a":
                link = False
            elif end not in INLINE:
                flush()
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == end:
                        del stack[k:]
                        link = False
                        break
            continue
        name = (name or odd or "").lower()
        if not name:
            continue
        attributes = attributes or odd_attributes or ""
        if name in RAW:
            close = _END[name].search(html, at) if not attributes.endswith("/") else None
            if close or not attributes.endswith("/"):
                at = close.end() if close else len(html)
            continue
        if name in INLINE:
            if name == "a":
                link = True
            elif name == "br":
                parts.append(" ")
            continue
        flush()
        if name in VOID:
            continue
        link = False
        if stack[-1][0] == "p":
            stack.pop()
        if name in ENDS:
            ended, stop = ENDS[name]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in stop:
                    break
                if stack[k][0] in ended:
                    del stack[k:]
                    if name != "tr" and name != "tbody":
                        break
        if name in ("html", "body") and any(s[0] == name for s in stack):
            continue
        stack.append((name, tree.add(name, attributes, stack[-1][1])))
    flush()
    return tree


@lru_cache(maxsize=20_000)
def _roles(names: str) -> tuple[str, ...]:
    parts = [p.lower() for p in _PART.findall(names)]
    found = {_OWN[p] for p in parts if p in _OWN} | {"hidden" for p in parts if p == "hidden"}
    joined = "-".join(parts)
    found |= {role for role, known in NAMES.items() for name in known if "-" in name and name in joined}
    if found - {"content"}:
        found.discard("content")  # "comment-body", "footer-content": the other name says what it is
    return tuple(sorted(found))


def _size(chars: int) -> int:
    return 0 if not chars else 1 if chars < 25 else 2 if chars < 70 else 3 if chars < 200 else 4


def features(tree: Tree) -> list[list[str]]:
    """Names of the features that hold for every node."""
    total, links = tree.chars[:], tree.linked[:]
    for i in range(len(total) - 1, 0, -1):
        total[tree.parent[i]] += total[i]
        links[tree.parent[i]] += links[i]
    whole = max(1, total[0])
    marks = [False] * len(total)
    for node, text in tree.blocks:
        marks[node] = marks[node] or "©" in text
    out = []
    for i, kind in enumerate(tree.kind):
        own, share = tree.chars[i], total[i] / whole
        dense = links[i] / total[i] if total[i] else 0.0
        roles = _roles(tree.names[i]) if tree.names[i] else ()
        out.append(["tag " + kind, f"own {_size(own)} {int(2.99 * dense)}", f"sub {int(3.99 * share)} {int(2.99 * dense)}", *["role " + r for r in roles],
                    *(["named " + kind] if roles else []), *(["sentence"] if tree.last[i] and tree.last[i] in ".!?…”\"" else []), *(["copyright"] if marks[i] else [])])
    return out


@dataclass
class Model:
    weights: dict[str, float]
    tie: tuple[tuple[float, float], tuple[float, float]]  # [parent][child], log

    def marginals(self, tree: Tree, given: list[list[str]] | None = None) -> tuple[list[float], list]:
        """P(content) of every node, and of every node but the root the joint with its parent.

        Upward each node sends its parent, for both parent states, the sum over its own states;
        downward the parent sends what it knows without that child.
        """
        get = self.weights.get
        up = [sum([get(f, 0.0) for f in fs]) for fs in (given or features(tree))]  # log-odds of content, all evidence below included
        sent, parent = [0.0] * len(up), tree.parent
        (t00, t01), (t10, t11) = ((exp(x) for x in row) for row in self.tie)
        for i in range(len(up) - 1, 0, -1):
            odds = exp(min(30.0, max(-30.0, up[i])))
            sent[i] = log((t10 + t11 * odds) / (t00 + t01 * odds))
            up[parent[i]] += sent[i]
        full, joint = up[:], [None] * len(up)
        for i in range(1, len(up)):
            above = exp(min(30.0, max(-30.0, full[parent[i]] - sent[i])))
            odds = exp(min(30.0, max(-30.0, up[i])))
            full[i] = up[i] + log((t01 + above * t11) / (t00 + above * t10))
            joint[i] = (t00, t01 * odds, above * t10, above * t11 * odds)
        return [1 / (1 + exp(-min(30.0, max(-30.0, x)))) for x in full], joint


def gold(tree: Tree) -> list[int]:
    """States of a labelled page: inherited from ``data-keep``; above a label, content if any below is."""
    state: list[int | None] = []
    for keep, parent in zip(tree.keep, tree.parent):
        state.append(int(keep) if keep is not None else state[parent] if parent >= 0 else None)
    for i in range(len(state) - 1, 0, -1):
        if state[i] == 1 and state[tree.parent[i]] is None:
            state[tree.parent[i]] = 2
        elif state[i] == 2 and state[tree.parent[i]] is None:
            state[tree.parent[i]] = 2
    return [1 if s in (1, 2) else 0 for s in state]


@lru_cache(maxsize=2)
def fit(pages: int = 400, rounds: int = 80, seed: int = 7) -> Model:
    """Fit the potentials on labelled pages: observed minus expected feature and pair counts, with a ridge."""
    trees = [parse(p) for p in labelled_pages(pages, seed)]
    found, states = [features(t) for t in trees], [gold(t) for t in trees]
    names = {f: i for i, f in enumerate(sorted({f for fs in found for node in fs for f in node}))}
    value, first, second = np.zeros(len(names) + 4), np.zeros(len(names) + 4), np.zeros(len(names) + 4)
    for turn in range(1, rounds + 1):
        model = _model(names, value)
        grad = -0.01 * value
        for tree, fs, y in zip(trees, found, states):
            p, joint = model.marginals(tree, fs)
            for i, node in enumerate(fs):
                off = y[i] - p[i]
                if abs(off) > 1e-4:
                    for f in node:
                        grad[names[f]] += off
                if i:
                    total = sum(joint[i])
                    for k in range(4):
                        grad[len(names) + k] -= joint[i][k] / total
                    grad[len(names) + 2 * y[tree.parent[i]] + y[i]] += 1
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        value = value + 0.2 * (first / (1 - 0.9 ** turn)) / (np.sqrt(second / (1 - 0.99 ** turn)) + 1e-8)
    return _model(names, value)


def _model(names: dict[str, int], value: np.ndarray) -> Model:
    t = value[len(names):].tolist()
    return Model({f: float(value[i]) for f, i in names.items()}, ((t[0], t[1]), (t[2], t[3])))


def main_text(html: str, model: Model) -> str:
    """Blocks whose node is content, in page order, joined by an empty line."""
    tree = parse(html)
    if not tree.blocks:
        return ""
    p, _ = model.marginals(tree)
    return "\n\n".join(text for node, text in tree.blocks if p[node] >= 0.5)


def extract(pages: DataFrame, html: str = "html", name: str = "text", model: Model | None = None, keep_html: bool = False) -> DataFrame:
    """Add the main text of every page; null and empty pages have none.

    Whole pages are read. Repeated rows are extracted each. Other columns pass through; a column
    with the name of the result is replaced.
    """
    pages = free_names(pages, [name])
    kept = [c for c in pages.columns if keep_html or c != html]
    shared = pages.sparkSession.sparkContext.broadcast(model or fit())  # a few hundred weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, html):
                texts = [main_text(h or "", shared.value) for h in part.column(part.schema.get_field_index(html)).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in kept] + [pa.array(texts, pa.string())], names=[*kept, name])

    return pages.mapInArrow(run, T.StructType([*[pages.schema[c] for c in kept], T.StructField(name, T.StringType())]))
