"""Main text of pages by a tree-structured graphical model.

Each block element and each run of text is a variable: part of the main text or not. A potential for every pair of
parent and child, by the child's kind of element, and one for what is seen of a node (its hint, or for a text its
length, link share and ending) are counted on labelled pages. Messages pass once from the leaves up and once from the
page down; the product of what reaches a text is its marginal, and texts of at least one half are kept. A tree has
no cycles, so the marginals are exact.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from corpus_engine.llm.frames import extended
from corpus_engine.llm.html_labels import PAGES
from corpus_engine.llm.html_tree import Block, Page, parse

PAGE = 2  # state of the page itself, of which no label is asked
SMOOTH = 0.5
#: What is seen of one text counts less than where it stands: neighbouring features repeat each other.
TEXT_WEIGHT = 0.5


def length_class(text: str) -> str:
    words = text.count(" ") + 1
    return "1" if words < 2 else "5" if words < 6 else "20" if words < 21 else "60" if words < 61 else "more"


def seen_of(block: Block) -> list[tuple[str, str]]:
    text = block.text
    linked = "none" if block.linked < 0.05 else "some" if block.linked < 0.5 else "most"
    return [("length", length_class(text)), ("linked", linked), ("ends", "." if text[-1] in ".!?:;\"'”»…" else "-"), ("mark", "©" if text[0] == "©" else "-")]


@dataclass
class Model:
    """``edge[group][parent state]`` and ``seen[feature][value]``: the odds of both states."""

    edge: dict[str, list[tuple[float, float]]]
    seen: dict[tuple[str, str], tuple[float, float]]


@lru_cache(maxsize=4)
def train(pages: tuple[str, ...] = tuple(PAGES)) -> Model:
    """Counts of the labelled pages, smoothed; a node without a label of its own has its parent's."""
    edges = defaultdict(lambda: [[SMOOTH, SMOOTH] for _ in range(3)])
    seen: dict = defaultdict(lambda: [SMOOTH, SMOOTH])
    total: dict = defaultdict(lambda: [0.0, 0.0])

    def count(features: list[tuple[str, str]], state: int) -> None:
        for name, value in features:
            seen[name, value][state] += 1
            total[name][state] += 1

    for html in pages:
        page, state = parse(html), []
        for i, parent in enumerate(page.parent):
            above = state[parent] if parent >= 0 else PAGE
            own = page.keep[i] if page.keep[i] is not None else (above if above != PAGE else 0)
            state.append(own)
            edges[page.group[i]][above][own] += 1
            count([("hint", page.hint[i])], own)
        for block in page.blocks:
            above = state[block.node] if block.node >= 0 else PAGE
            own = above if above != PAGE else 1
            edges["run"][above][own] += 1
            count(seen_of(block), own)
    edge = {g: [(a[0] / sum(a), a[1] / sum(a)) for a in rows] for g, rows in edges.items()}
    sizes = {name: sum(1 for n, _ in seen if n == name) for name in total}
    odds = {k: tuple(v[s] / (total[k[0]][s] + SMOOTH * sizes[k[0]]) for s in (0, 1)) for k, v in seen.items()}
    return Model(edge, odds)


def marginals(page: Page, model: Model) -> list[float]:
    """Probability of each block to belong to the main text, by one pass up the tree and one down."""
    nodes, unknown = len(page.parent), [(0.5, 0.5)] * 3
    parent = [*page.parent, *(b.node for b in page.blocks)]
    group = [*page.group, *["run"] * len(page.blocks)]
    own: list[tuple[float, float]] = [model.seen.get(("hint", h), (1.0, 1.0)) for h in page.hint]
    for block in page.blocks:
        a = b = 1.0
        for feature in seen_of(block):
            x, y = model.seen.get(feature, (1.0, 1.0))
            a, b = a * x**TEXT_WEIGHT, b * y**TEXT_WEIGHT
        own.append((a, b))
    below = [list(x) for x in own]  # product of a node's own potential and its children's messages
    sent: list[tuple[float, float, float]] = [(1.0, 1.0, 1.0)] * len(parent)
    for i in range(len(parent) - 1, -1, -1):
        a, b = below[i]
        scale = (a + b) or 1.0
        a, b = below[i] = [a / scale, b / scale]
        table = model.edge.get(group[i], unknown)
        sent[i] = tuple(t[0] * a + t[1] * b for t in table)
        if parent[i] >= 0:
            up = below[parent[i]]
            up[0] *= sent[i][0]
            up[1] *= sent[i][1]
            if up[0] + up[1] < 1e-200:
                up[0], up[1] = up[0] * 1e200, up[1] * 1e200
    belief: list[tuple[float, float]] = []
    for i in range(len(parent)):
        table = model.edge.get(group[i], unknown)
        if parent[i] < 0:
            a, b = table[PAGE]
        else:
            x, y = belief[parent[i]]
            x, y = x / max(sent[i][0], 1e-300), y / max(sent[i][1], 1e-300)  # without what this child said
            a, b = table[0][0] * x + table[1][0] * y, table[0][1] * x + table[1][1] * y
        a, b = a * below[i][0], b * below[i][1]
        scale = (a + b) or 1.0
        belief.append((a / scale, b / scale))
    return [belief[nodes + k][1] for k in range(len(page.blocks))]


def main_text(html: str | None, model: Model, least: float = 0.5) -> str:
    """Blocks of the main text in page order, joined by an empty line."""
    page = parse(html or "")
    return "\n\n".join(b.text for b, p in zip(page.blocks, marginals(page, model), strict=True) if p >= least)


def extract(pages: DataFrame, html: str = "html", least: float = 0.5) -> DataFrame:
    """All columns of ``pages`` and ``_text``, the main text of the whole html.

    Null, empty or text-free html gives an empty text. Character references are decoded, white space inside a block
    is one space; nothing else is dropped or cut. Rows are treated each for itself, repeated ones too.
    """
    at, model = pages.columns.index(html), train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), model, least) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "_text"])

    return pages.mapInArrow(run, extended(pages, _text="string"))
