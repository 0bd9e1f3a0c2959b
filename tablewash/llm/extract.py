"""Main text of pages: a tree-structured graphical model over the nodes of each page."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewash.llm.common import fresh, map_batches
from tablewash.llm.dom import FEATURES, Page
from tablewash.llm.labelled_pages import labelled_pages

#: Labelled pages that the model is trained from, and steps of training.
PAGES, STEPS = 400, 160
#: Pages whose trees are solved together.
TOGETHER = 128


@dataclass(frozen=True)
class Model:
    """Scores of being content by features, and of (parent, child) labels for elements and for text."""

    weights: np.ndarray  # FEATURES
    pairs: np.ndarray  # text or element, parent label, child label


class Forest:
    """Trees of several pages as arrays; nodes of one depth are handled at once."""

    def __init__(self, parents: list[list[int]], depths: list[list[int]], is_text: list[list[bool]]):
        sizes = [len(p) for p in parents]
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.parent = np.concatenate([np.array(p) + s for p, s in zip(parents, self.starts)])
        self.kind = np.concatenate([np.array(t, int) for t in is_text])
        depth = np.concatenate([np.array(d) for d in depths])
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(depth.max() + 2))
        self.levels = [order[a:b] for a, b in zip(cuts, cuts[1:])]
        self.roots, self.levels = self.levels[0], self.levels[1:]

    def marginals(self, own: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Sum-product: messages from the leaves up and from the roots down. ``own`` holds a score for
        each node and label. Gives each node's label probabilities, each (parent, child) pair's,
        and the sum of the log partition functions."""
        inside = own.copy()
        up = np.zeros_like(own)
        for level in reversed(self.levels):
            # up[child, label of parent] = log sum over the child's label
            scores = inside[level][:, None, :] + pairs[self.kind[level]]
            up[level] = np.logaddexp(scores[:, :, 0], scores[:, :, 1])
            np.add.at(inside, self.parent[level], up[level])
        belief = inside.copy()
        both = np.zeros((len(own), 2, 2))
        for level in self.levels:
            parent = self.parent[level]
            without = belief[parent] - up[level]
            scores = without[:, :, None] + pairs[self.kind[level]] + inside[level][:, None, :]
            belief[level] = np.logaddexp(scores[:, 0], scores[:, 1])
            both[level] = scores
        norm = np.logaddexp(belief[:, 0], belief[:, 1])
        return np.exp(belief - norm[:, None]), np.exp(both - norm[:, None, None]), float(norm[self.roots].sum())


def solve(pages: list[Page], model: Model) -> list[np.ndarray]:
    """The probability of being content of every node of every page."""
    forest = _forest(pages)
    x = np.array([f for p in pages for f in p.features()])
    own = np.zeros((len(x), 2))
    own[:, 1] = x @ model.weights
    chance = forest.marginals(own, model.pairs)[0][:, 1]
    return [chance[a:b] for a, b in zip(forest.starts, forest.starts[1:])]


def _forest(pages: list[Page]) -> Forest:
    return Forest([p.parent for p in pages], [p.depth for p in pages], [[k == 0 for k in p.kind] for p in pages])


def train(examples: list[tuple[str, list[str]]], steps: int = STEPS) -> Model:
    """Fit the model to labelled pages, (html, blocks of main text) each, by the likelihood of the
    labels. Its gradient is what the labels have of each feature and pair less what the marginals
    expect. A run of text is content if it is a block of the main text; an element is if it holds
    content and no more other text than content, but the page's own frame never is."""
    pages = [Page(html) for html, _ in examples]
    labels = np.concatenate([_labels(p, blocks) for p, (_, blocks) in zip(pages, examples)])
    forest = _forest(pages)
    x = np.array([f for p in pages for f in p.features()])
    below = np.concatenate(forest.levels)
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (forest.kind[below], labels[forest.parent[below]], labels[below]), 1)
    weights, pairs = np.zeros(FEATURES), np.zeros((2, 2, 2))
    state = [[np.zeros_like(v), np.zeros_like(v)] for v in (weights, pairs)]
    for step in range(1, steps + 1):
        own = np.zeros((len(x), 2))
        own[:, 1] = x @ weights
        chance, both, _ = forest.marginals(own, pairs)
        expected = np.zeros((2, 2, 2))
        np.add.at(expected, forest.kind[below], both[below])
        slopes = (x.T @ (labels - chance[:, 1]) - 0.5 * weights, seen - expected - 0.5 * pairs)
        for value, slope, (mean, square) in zip((weights, pairs), slopes, state):
            mean += 0.1 * (slope - mean)
            square += 0.01 * (slope * slope - square)
            value += 0.15 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return Model(weights, pairs)


def _labels(page: Page, blocks: list[str]) -> np.ndarray:
    wanted = set(blocks)
    own = [1 if t and t in wanted else 0 for t in page.text]
    good = [len(t) * y for t, y in zip(page.text, own)]
    bad = [len(t) * (1 - y) for t, y in zip(page.text, own)]
    for i in range(len(own) - 1, 0, -1):
        good[page.parent[i]] += good[i]
        bad[page.parent[i]] += bad[i]
    frame = {i for i, k in enumerate(page.kind) if i == 0 or page.depth[i] <= 2 and not page.text[i] and k in (1, 2)}
    return np.array([y if t else int(g > 0 and g >= b and i not in frame)
                     for i, (y, t, g, b) in enumerate(zip(own, page.text, good, bad))])


def main_blocks(pages: list[str], model: Model) -> list[list[str]]:
    """The runs of text of each page that are content, in page order."""
    out: list[list[str]] = []
    for at in range(0, len(pages), TOGETHER):
        some = [Page(html) for html in pages[at : at + TOGETHER]]
        for page, chance in zip(some, solve(some, model)):
            out.append([t for t, c in zip(page.text, chance) if t and c >= 0.5])
    return out


def extract_text(
    df: DataFrame, html: str = "html", out: str = "main_text", pages: int = PAGES, model: Model | None = None
) -> DataFrame:
    """``df`` without its html, with the main text of each page in ``out``: the blocks that are content,
    joined by line breaks in page order, each with its white space as single spaces.

    A page is read as a tree of block elements and runs of text; markup, scripts, styles and the
    fields of forms have no text. The probability of each node being content comes from its own
    features and from its neighbours' by sum-product over the tree; ``model`` is trained from
    ``pages`` labelled pages if none is given, a bounded set whatever the size of ``df``. Whole
    pages are read in batches, each page in one task.

    A NULL or empty html, or one without content, gives an empty text. Html that is not well formed
    is read as browsers do where that matters: open paragraphs, items and cells end where the next
    begins, stray end tags are passed over. Repeated rows are read each. An empty table gives an
    empty table. A column of ``df`` named ``out`` is left out; other columns are carried along.
    """
    model = model or train(labelled_pages(pages))
    rest = df.drop(html, out)
    schema = rest.withColumn(out, F.lit("")).schema
    (whole,) = fresh(df, "whole_html")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            column, texts = batch.column(batch.num_columns - 1), []
            for at in range(0, len(column), TOGETHER):
                texts += ["\n".join(b) for b in main_blocks(column.slice(at, TOGETHER).to_pylist(), model)]
            return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], schema.names)

        return step

    return map_batches(df.select(*rest.columns, F.coalesce(F.col(html), F.lit("")).alias(whole)), make, schema)
