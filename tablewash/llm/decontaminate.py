"""Passages of a benchmark inside documents: SimHash of item-sized windows, multi-index search, anchors, verification."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewash.llm.common import fresh, materialize, shingle_hashes, text_parts, word_hashes

WORDS, THRESHOLD = 5, 0.8
BITS, RADIUS, PARTS = 64, 15, 4
#: Windows of a class are as long as its longest item; its shortest is at most this much shorter.
CLASS_RATIO = 1.15
#: Items that are searched for at a time. A larger benchmark is searched for block by block.
ITEMS_AT_ONCE, BYTES_AT_ONCE = 2048, 1 << 20
#: Words of one document that are held as votes at a time.
HELD_WORDS = 1 << 15


def near_values(bits: int, radius: int) -> np.ndarray:
    """All values of ``bits`` bits with at most ``radius`` ones."""
    values = np.arange(1 << bits, dtype=np.uint32)
    return values[np.bitwise_count(values) <= radius]


@dataclass
class Class:
    """Items of about one length: their fingerprints, and for every part of a fingerprint and every
    value of it the items whose part is within the radius of the part."""

    window: int
    shortest: int
    step: int
    items: list[int] = field(default_factory=list)
    prints: np.ndarray | None = None
    tables: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)


class Index:
    """What is searched for: items by class, with the weights of their shingles. A shingle of an item
    weighs 1 divided by the number of different items that have it, so that phrases of many items count
    little; any other shingle of a window weighs 1. ``shared`` tells for each item which of its shingles other
    items have too, and how many have them; without it they are counted among the items given."""

    def __init__(
        self, ids: list, texts: list[str], radius: int = RADIUS, words: int = WORDS, threshold: float = THRESHOLD,
        shared: list[list[tuple[int, int]]] | None = None,
    ):
        self.ids, self.radius, self.words = ids, radius, words
        column = pa.array(texts, pa.string())
        self.shingles, self.counts, sizes, prints = [], [], [], []
        for _, data, offsets in text_parts(column):
            hashes, starts = word_hashes(data, offsets)
            for s, e in zip(starts, starts[1:]):
                all_of_it = shingle_hashes(hashes[s:e], words)
                kinds, counts = np.unique(all_of_it, return_counts=True)
                self.shingles.append(kinds)
                self.counts.append(counts)
                sizes.append(int(e - s))
                prints.append(fingerprint(all_of_it))
        if shared is None:
            once = dict(zip(texts, self.shingles)).values()
            known, items = np.unique(np.concatenate([*once, np.zeros(0, np.uint64)]), return_counts=True)
            self.weights = [1.0 / items[np.searchsorted(known, k)] for k in self.shingles]
        else:
            self.weights = [np.ones(len(k)) for k in self.shingles]
            for kinds, weights, told in zip(self.shingles, self.weights, shared):
                if told:
                    kind, items = np.array(told, np.int64).T
                    weights[np.searchsorted(kinds, kind.copy().view(np.uint64))] = 1.0 / items
        self.sizes, self.prints = np.array(sizes), np.array(prints, np.uint64)
        self.totals = [float((n * w).sum()) for w, n in zip(self.weights, self.counts)]
        self.classes: list[Class] = []
        for i in np.argsort(-self.sizes, kind="stable"):
            n = int(self.sizes[i])
            if n == 0:
                continue
            if not self.classes or n * CLASS_RATIO < self.classes[-1].window:
                self.classes.append(Class(n, n, max(1, n // 9)))
            self.classes[-1].items.append(int(i))
            self.classes[-1].shortest = n
        for c in self.classes:
            self._build(c)
        self._anchor(threshold)

    def _anchor(self, threshold: float) -> None:
        """Anchors: shingles of which every window that reaches ``threshold`` for an item has one at least.
        The similarity is at most the weight of the item's shingles in the window divided by the weight of
        all of them, so the item's most common ones are left out as long as they weigh less than that."""
        kinds, items = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for i in np.flatnonzero(self.sizes >= self.words):
            weight = self.weights[i]
            order = np.argsort(weight, kind="stable")
            kept = order[np.cumsum((self.counts[i] * weight)[order]) >= (threshold - 1e-9) * self.totals[i]]
            kinds.append(self.shingles[i][kept])
            items.append(np.full(len(kept), i))
        kind, item = np.concatenate(kinds), np.concatenate(items)
        order = np.argsort(kind, kind="stable")
        self.anchors, first = np.unique(kind[order], return_index=True)
        self.anchor_starts, self.anchor_items = np.append(first, len(kind)), item[order]
        self.anchor_bits = np.zeros(1 << 20, bool)
        self.anchor_bits[self.anchors & np.uint64((1 << 20) - 1)] = True

    def anchored(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every (place, item) where the shingle at the place is an anchor of the item."""
        place = np.flatnonzero(self.anchor_bits[shingles & np.uint64((1 << 20) - 1)])
        at = np.searchsorted(self.anchors, shingles[place])
        at[at == len(self.anchors)] = 0
        hit = self.anchors[at] == shingles[place] if len(self.anchors) else np.zeros(len(at), bool)
        place, at = place[hit], at[hit]
        count = self.anchor_starts[at + 1] - self.anchor_starts[at]
        entry = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.anchor_starts[at], count)
        return np.repeat(place, count), self.anchor_items[entry]

    def _build(self, c: Class) -> None:
        c.prints = self.prints[c.items]
        width = BITS // PARTS
        flips = near_values(width, self.radius // PARTS)
        for part in range(PARTS):
            own = (c.prints >> np.uint64(part * width)).astype(np.uint32) & np.uint32((1 << width) - 1)
            values = (own[:, None] ^ flips[None, :]).ravel()
            order = np.argsort(values, kind="stable")
            items = np.repeat(np.arange(len(own)), len(flips))[order]
            c.tables.append((np.searchsorted(values[order], np.arange((1 << width) + 1)).astype(np.int64), items))

    def candidates(self, c: Class, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every (window, item of the class) whose fingerprints differ in at most ``radius`` bits: of
        the parts of such a pair one at least differs in at most radius // PARTS bits."""
        width = BITS // PARTS
        windows, items = [], []
        for part, (starts, entries) in enumerate(c.tables):
            value = (prints >> np.uint64(part * width)).astype(np.int64) & ((1 << width) - 1)
            count = starts[value + 1] - starts[value]
            some = np.flatnonzero(count)
            count = count[some]
            window = np.repeat(some, count)
            at = np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts[value[some]], count)
            item = entries[at]
            near = np.bitwise_count(prints[window] ^ c.prints[item]) <= self.radius
            windows.append(window[near])
            items.append(item[near])
        pairs = np.sort(np.concatenate(windows) * np.int64(len(c.items)) + np.concatenate(items))
        pairs = pairs[np.diff(pairs, prepend=-1) > 0]
        return pairs // len(c.items), pairs % len(c.items)

    def similarity(self, item: int, shingles: np.ndarray) -> float:
        """Weighted Jaccard similarity: sum of w min(a, b) / sum of w max(a, b) over shingle counts."""
        kinds, counts = np.unique(shingles, return_counts=True)
        _, i, j = np.intersect1d(kinds, self.shingles[item], assume_unique=True, return_indices=True)
        weights = np.ones(len(kinds))
        weights[i] = self.weights[item][j]
        least = (np.minimum(counts[i], self.counts[item][j]) * weights[i]).sum()
        return float(least / ((counts * weights).sum() + self.totals[item] - least))

    def best_place(
        self, item: int, shingles: np.ndarray, low: int, high: int, end: int, threshold: float
    ) -> tuple[float, int]:
        """The best similarity of ``item`` to item-sized windows that start in [low, high), and where; 0
        if none reaches ``threshold``.
        ``shingles`` and ``end`` belong to the document: its shingles by first word, its words."""
        n = int(self.sizes[item])
        size = max(1, n - self.words + 1)
        stop = max(low + 1, min(high, end - n + 1))
        region = shingles[low : stop + size - 1]
        own = self.shingles[item]
        at = np.minimum(np.searchsorted(own, region), len(own) - 1)
        same = own[at] == region
        weight = np.where(same, self.weights[item][at], 1.0)
        sums = np.cumsum(np.concatenate([np.zeros((2, 1)), np.stack([weight, weight * same])], axis=1), axis=1)
        first = np.arange(stop - low)
        all_of_it, common = sums[:, np.minimum(first + size, len(region))] - sums[:, np.minimum(first, len(region))]
        # With repeated shingles this is too large, never too small.
        bound = common / (all_of_it + self.totals[item] - common)
        best = (0.0, low)
        for q in np.argsort(-bound, kind="stable"):
            if bound[q] < threshold - 1e-9 or bound[q] <= best[0] + 1e-9:
                break
            s = self.similarity(item, region[q : q + size])
            if s > best[0] + 1e-9:
                best = (s, low + int(q))
        return best


def bits_of(shingles: np.ndarray) -> np.ndarray:
    """The 64 bits of each hash, as a row of zeros and ones."""
    return np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1)


def fingerprint(shingles: np.ndarray) -> int:
    """SimHash: a bit is set if more than half of the shingles set it."""
    return int(np.packbits(2 * bits_of(shingles).sum(axis=0, dtype=np.int64) > len(shingles)).view(np.uint64)[0])


def vote_sums(shingles: np.ndarray, longest: int) -> list[np.ndarray]:
    """Row i of array k: how many of the 2 ** k shingles from i on set each bit. Runs of any length up
    to ``longest`` are sums of a few of these rows."""
    sums = [bits_of(shingles)]
    while 2 << (len(sums) - 1) <= min(longest, len(shingles)):
        half = 1 << (len(sums) - 1)
        last = sums[-1] if half < 128 else sums[-1].astype(np.uint16 if half < 32768 else np.uint32)
        sums.append(last[:-half] + last[half:])
    return sums


def window_prints(sums: list[np.ndarray], starts: np.ndarray, count: int) -> np.ndarray:
    """SimHash of the ``count`` shingles from each of ``starts`` on."""
    out = np.empty(len(starts), np.uint64)
    for at in range(0, len(starts), 4096):
        p, ones, done = starts[at : at + 4096], None, 0
        for k in range(len(sums) - 1, -1, -1):
            if count >> k & 1:
                some = sums[k].take(p + done, axis=0)
                ones = some if ones is None else ones + some if count > 255 else np.add(ones, some, out=ones)
                done += 1 << k
        out[at : at + 4096] = np.packbits(ones > (count >> 1), axis=1).view(np.uint64)[:, 0]
    return out


def search(index: Index, hashes: np.ndarray, starts: np.ndarray, threshold: float) -> Iterator[tuple[int, int, float, int]]:
    """(text, item, similarity, first word) of the best place of each item found in each of some
    neighbouring texts, given the hashes of their words and where each text's words start."""
    best: dict[tuple[int, int], tuple[float, int]] = {}

    def note(text: int, item: int, found: tuple[float, int]) -> None:
        """``found`` is a similarity and the word of all texts at which the place starts."""
        key, place = (text, item), found[1] - int(starts[text])
        if found[0] >= threshold and (key not in best or (found[0], -place) > (best[key][0], -best[key][1])):
            best[key] = (found[0], place)

    lengths = np.diff(starts)
    longest = max((c.window for c in index.classes), default=0)
    slack = 2 * longest
    stride = max(HELD_WORDS, 4 * slack)
    for base in range(0, len(hashes), stride):
        part = hashes[base : base + stride + slack]
        if len(part) < 1 or (base and len(part) <= slack // 2):
            break
        shingles = shingle_hashes(part, index.words) if len(part) >= index.words else np.zeros(0, np.uint64)
        first = np.searchsorted(starts, base, "right") - 1
        last = np.searchsorted(starts, base + len(part), "left")
        bounds = np.clip(starts[first : last + 1] - base, 0, len(part))
        begins, ends = bounds[:-1], bounds[1:]
        doc_of = np.repeat(np.arange(len(begins)), ends - begins)
        end_of, begin_of = ends[doc_of], begins[doc_of]
        for text, item, low, high in _anchored_spans(index, shingles, begin_of, end_of, doc_of + first, lengths):
            end = int(end_of[low])
            found = index.best_place(item, shingles[: end - index.words + 1], low, high + 1, end, threshold)
            note(text, item, (found[0], base + found[1]))
        sums = vote_sums(shingles, longest) if len(shingles) else []
        for c in index.classes:
            run = min(index.words, c.window)
            count = c.window - run + 1
            # Windows inside a text: every ``step`` words, at its start and at its end.
            full = ends - begins >= c.window
            p = np.concatenate([np.arange(0, len(part), c.step), begins[full], ends[full] - c.window])
            p = np.sort(p[p + c.window <= end_of[np.minimum(p, len(part) - 1)]])
            p = p[np.diff(p, prepend=-1) > 0]
            # A text shorter than a window is one; what is cut off a longer text is not.
            short = np.flatnonzero(~full & (ends - begins == lengths[first:last]) & (ends - begins >= max(1, int(c.shortest * threshold))))
            prints = np.empty(len(p) + len(short), np.uint64)
            if run == index.words:
                prints[: len(p)] = window_prints(sums, p, count)
            else:
                prints[: len(p)] = [fingerprint(shingle_hashes(part[x : x + c.window], index.words)) for x in p]
            prints[len(p) :] = [fingerprint(shingle_hashes(part[begins[d] : ends[d]], index.words)) for d in short]
            p = np.concatenate([p, begins[short]])
            if not len(p):
                continue
            windows, items = index.candidates(c, prints)
            for w, i in zip(windows.tolist(), items.tolist()):
                item, at = c.items[i], int(p[w])
                n = int(index.sizes[item])
                doc_begin, doc_end = int(begin_of[at]), int(end_of[at])
                low = max(doc_begin, at - c.step)
                high = max(low + 1, min(doc_end, at + c.step + c.window - n + 1))
                if n < index.words:
                    spans = [(index.similarity(item, shingle_hashes(part[q : min(q + n, doc_end)], index.words)), q) for q in range(low, high)]
                    found = max(spans, key=lambda x: (x[0], -x[1]))
                elif doc_end - doc_begin < index.words:
                    found = (index.similarity(item, shingle_hashes(part[doc_begin:doc_end], index.words)), doc_begin)
                else:
                    found = index.best_place(item, shingles[: doc_end - index.words + 1], low, high, doc_end, threshold)
                note(int(first) + int(doc_of[at]), item, (found[0], base + found[1]))
    for (text, item), (similarity, place) in sorted(best.items()):
        yield text, item, similarity, place


def _anchored_spans(
    index: Index, shingles: np.ndarray, begin_of: np.ndarray, end_of: np.ndarray, text_of: np.ndarray, lengths: np.ndarray
) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, first start, last start) of all item-sized windows that hold an anchor of their item."""
    place, item = index.anchored(shingles)
    inside = place + index.words <= end_of[place]
    place, item = place[inside], item[inside]
    n, text, begin, end = index.sizes[item], text_of[place], begin_of[place], end_of[place]
    low, high = np.maximum(begin, place - n + index.words), np.minimum(place, end - n)
    short = (lengths[text] < n) & (end - begin == lengths[text])
    low[short] = high[short] = begin[short]
    order = np.lexsort((low, item, text))
    order = order[low[order] <= high[order]]
    text, item, low, high = text[order], item[order], low[order], high[order]
    new = np.ones(len(order), bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (low[1:] > high[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(order))[: len(first)] - 1
    yield from zip(text[first].tolist(), item[first].tolist(), low[first].tolist(), high[last].tolist())


def find_passages(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    threshold: float = THRESHOLD, radius: int = RADIUS, words: int = WORDS,
) -> DataFrame:
    """One row for each row of ``docs`` and item of ``benchmark`` found in it: the columns of ``docs`` but
    the text, the ``item`` column, ``similarity`` and ``first_word`` (from 0) of the best place.

    Every document is walked in windows as long as the items. A window's SimHash over its shingles of
    ``words`` words (any letter case) is looked up in a multi-index of the items' fingerprints, which
    gives every item within ``radius`` bits; a candidate is verified by the weighted Jaccard
    similarity of the shingles at all item-sized places around the window, which must reach
    ``threshold``. As fingerprints of edited passages may differ in more bits, all item-sized places
    that hold one of the item's anchors are verified too; no place that reaches ``threshold`` lacks one.
    Documents are not shuffled, and their neighbours in a batch only share the arrays.

    The items go to every task, at most ``ITEMS_AT_ONCE`` of them and ``BYTES_AT_ONCE`` bytes of text at
    a time (or one item): a larger benchmark is searched for in several passes whose results are united.
    How many items have a shingle is counted over the whole benchmark before, so results do not depend
    on the passes.

    NULL or empty texts, in either table, match nothing. An item or a document of fewer words than
    a shingle is one shingle. Repeated documents and items give rows each. Empty tables give an empty
    table. A column of ``docs`` named like an output column is left out.
    """
    added = (item, "similarity", "first_word")
    kept = [c for c in docs.columns if c != text and c not in added]
    (whole,) = fresh(docs, "whole_text")
    ready = docs.select(*kept, F.lower(F.coalesce(F.col(text), F.lit(""))).alias(whole))
    schema = docs.select(*kept).withColumns({
        item: F.lit(None).cast(benchmark.schema[item].dataType), "similarity": F.lit(0.0), "first_word": F.lit(0).cast("long")}).schema
    out = None
    for sent in _sent(benchmark, item, item_text, words):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = None
            for batch in batches:
                index = index or Index(*sent.value[:2], radius=radius, words=words, threshold=threshold, shared=sent.value[2])
                found = list(_found(batch, index, threshold))
                if found:
                    row, i, similarity, word = zip(*found)
                    columns = [c.take(pa.array(row, pa.int64())) for c in batch.columns[:-1]]
                    yield pa.RecordBatch.from_arrays([
                        *columns, pa.array([index.ids[x] for x in i]), pa.array(similarity, pa.float64()),
                        pa.array(word, pa.int64())], schema.names)

        found = ready.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def without_passages(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    threshold: float = THRESHOLD, radius: int = RADIUS, words: int = WORDS,
) -> DataFrame:
    """The rows of ``docs`` in which ``find_passages`` finds no item, with all their columns."""
    (whole,) = fresh(docs, "whole_text")
    out = docs
    for sent in _sent(benchmark, item, item_text, words):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = None
            for batch in batches:
                index = index or Index(*sent.value[:2], radius=radius, words=words, threshold=threshold, shared=sent.value[2])
                clean = np.ones(batch.num_rows, bool)
                clean[[row for row, *_ in _found(batch, index, threshold)]] = False
                yield batch.select(range(batch.num_columns - 1)).filter(pa.array(clean))

        out = out.withColumn(whole, F.lower(F.coalesce(F.col(text), F.lit("")))).mapInArrow(run, docs.schema)
    return out


def _shared_shingles(items: DataFrame, words: int) -> DataFrame:
    """For each item (``no``) its shingles that different items have too, with the number of items that have them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in text_parts(batch.column(1)):
                hashes, starts = word_hashes(data, offsets)
                kinds = [np.unique(shingle_hashes(hashes[s:e], words)) for s, e in zip(starts, starts[1:])]
                no = np.repeat(batch.column(0).to_numpy()[first : first + len(kinds)], list(map(len, kinds)))
                yield pa.RecordBatch.from_arrays([pa.array(no), pa.array(np.concatenate(kinds).view(np.int64))], ["no", "kind"])

    kinds = items.select("no", "item_text").mapInArrow(cut, "no long, kind long")
    # Repeated items count once, or an edited passage of theirs would weigh too little.
    once = items.groupBy("item_text").agg(F.min("no").alias("no")).select("no", "item_text").mapInArrow(cut, "no long, kind long")
    often = once.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return kinds.join(often, "kind").groupBy("no").agg(F.collect_list(F.struct("kind", "n")).alias("shared"))


def _sent(benchmark: DataFrame, item: str, item_text: str, words: int) -> list:
    """The items, broadcast in parts of bounded size; one empty part if there are none. The driver
    holds one part at a time."""
    items = benchmark.select(F.col(item).alias("id"), F.lower(F.coalesce(F.col(item_text), F.lit(""))).alias("item_text"))
    items = materialize(items.withColumn("no", F.monotonically_increasing_id()))
    ready = items.join(_shared_shingles(items, words), "no", "left").select("id", "item_text", "shared")
    send, out, part, size = benchmark.sparkSession.sparkContext.broadcast, [], ([], [], []), 0
    for row in ready.toLocalIterator():
        own = len(row.item_text.encode())
        if part[0] and (len(part[0]) >= ITEMS_AT_ONCE or size + own > BYTES_AT_ONCE):
            out.append(send(part))
            part, size = ([], [], []), 0
        for column, value in zip(part, (row.id, row.item_text, [tuple(x) for x in row.shared or ()])):
            column.append(value)
        size += own
    return [*out, send(part)]


def _found(batch: pa.RecordBatch, index: Index, threshold: float) -> Iterator[tuple[int, int, float, int]]:
    for first, data, offsets in text_parts(batch.column(batch.num_columns - 1)):
        hashes, starts = word_hashes(data, offsets)
        for text, i, similarity, word in search(index, hashes, starts, threshold):
            yield first + text, i, similarity, word
