"""Ranked search of given items over all documents, by groups of documents that hold the same terms."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewash.llm.common import fresh, materialize

#: Items whose texts take so many bytes are searched in one pass over the documents.
PART_BYTES = 1 << 20
#: Documents that share bitmaps.
BLOCK = 4096

#: ASCII letters in lower case, digits and all bytes of other characters stay; the rest parts terms.
_TERM = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM).split()


def _parts(items: DataFrame, part_bytes: int) -> Iterator[list]:
    """Items in parts of bounded size; the driver holds one part at a time."""
    part, size = [], 0
    for row in items.toLocalIterator():
        own = len(row.text)
        if part and size + own > part_bytes:
            yield part
            part, size = [], 0
        part.append(row)
        size += own + 64
    if part:
        yield part


def _matched(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """For each document its number of terms, and which terms of the vocabulary it holds how often."""
    schema = T.StructType([
        docs.schema["id"], T.StructField("n", T.LongType()),
        T.StructField("terms", T.ArrayType(T.IntegerType(), False)), T.StructField("tfs", T.ArrayType(T.LongType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        for batch in batches:
            sizes, found, lengths = [], [], []
            for text in batch.column(1):
                words = terms_of(text.as_py())
                own = [i for w in words if (i := get(w)) is not None]
                sizes.append(len(words))
                lengths.append(len(own))
                found.append(np.array(own, np.int64))
            key = np.repeat(np.arange(len(sizes)), lengths) << 32 | np.concatenate(found)
            key, times = np.unique(key, return_counts=True)
            ends = np.searchsorted(key, np.arange(len(sizes) + 1) << 32).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in ((key & 0xFFFFFFFF).astype(np.int32), times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], schema.names)

    return docs.mapInArrow(run, schema)


class BlockIndex:
    """Terms of a block of documents: a bitmap of the documents that hold a term, and what a term
    gives to the score of each of them."""

    def __init__(self, ends: np.ndarray, terms: np.ndarray, gains: np.ndarray):
        self.size = len(ends)
        doc = np.repeat(np.arange(self.size), np.diff(ends, prepend=0))
        self.terms = np.unique(terms)
        row = np.searchsorted(self.terms, terms)
        self.bits = np.zeros((len(self.terms), -(-self.size // 8)), np.uint8)
        np.bitwise_or.at(self.bits, (row, doc >> 3), np.left_shift(1, doc & 7).astype(np.uint8))
        key = row * self.size + doc
        order = np.argsort(key)
        self.key, self.gains = key[order], gains[order]
        first = np.searchsorted(row[order], np.arange(len(self.terms)))
        self.most = np.maximum.reduceat(self.gains, first) if len(first) else np.zeros(0, np.int64)

    def groups(self, rows: np.ndarray):
        """The documents by which of the terms they hold: distinct masks (one row of bits each), the
        documents in order of their masks, and where those of a mask start. Documents without any
        of the terms are left out."""
        bits = self.bits[rows]
        docs = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(bits, axis=0), count=self.size, bitorder="little"))
        own = np.unpackbits(bits, axis=1, count=self.size, bitorder="little")[:, docs]
        words = np.zeros((8 * -(-len(rows) // 64), len(docs)), np.uint8)
        packed = np.packbits(own, axis=0, bitorder="little")
        words[: len(packed)] = packed
        words = np.ascontiguousarray(words.T).view("<u8")
        order = np.argsort(words[:, 0], kind="stable") if words.shape[1] == 1 else np.lexsort(words.T)
        words = words[order]
        first = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]).any(axis=1)])) if len(docs) else np.zeros(0, np.int64)
        return own[:, order[first]], docs[order], first

    def best(self, rows: np.ndarray, times: np.ndarray, k: int, ids: np.ndarray, known: tuple) -> tuple:
        """The ``k`` best of ``known`` (scores, ids) and the documents of the block, by score and then id.

        No document of a mask can have more than the sum of what its terms give at most. Masks are
        scored by descending bound, until the next one is below the k-th best score found."""
        masks, docs, first = self.groups(rows)
        bound = (times * self.most[rows]) @ masks.astype(np.int64)
        sizes = np.diff(first, append=len(docs))
        order = np.argsort(-bound, kind="stable")
        at, ahead = 0, 4 * k
        while at < len(order):
            least = known[0][k - 1] if len(known[0]) >= k else 1
            if bound[order[at]] < least:
                break
            reach = at + 1 + int(np.searchsorted(np.cumsum(sizes[order[at:]]), ahead))
            chosen = order[at:reach]
            chosen = chosen[bound[chosen] >= least]
            own = docs[np.repeat(first[chosen], sizes[chosen]) + _within(sizes[chosen])]
            known = _merge(known, self._scores(rows, times, own), ids[own], k)
            at, ahead = reach, 2 * ahead
        return known

    def _scores(self, rows: np.ndarray, times: np.ndarray, docs: np.ndarray) -> np.ndarray:
        key = rows[:, None] * self.size + docs[None, :]
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return times @ np.where(self.key[at] == key, self.gains[at], 0)


def _within(sizes: np.ndarray) -> np.ndarray:
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _merge(known: tuple, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple:
    scores, ids = np.concatenate([known[0], scores]), np.concatenate([known[1], ids])
    order = np.lexsort((ids, -scores))[:k]
    order = order[scores[order] > 0]
    return scores[order], ids[order]


def _search(matched: DataFrame, items: list[tuple[int, list[int], list[int]]], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """The best documents of each partition: ``item`` (number), ``id`` and ``score``."""
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("id", T.LongType()), T.StructField("score", T.LongType())])
    wanted = [(no, np.array(terms), np.array(times, np.int64)) for no, terms, times in items]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {no: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for no, _, _ in wanted}
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                ids, n, terms, tfs = whole.slice(start, BLOCK).columns
                ends = terms.offsets.to_numpy()[1:].astype(np.int64) - terms.offsets[0].as_py()
                n, tf = n.to_numpy(), tfs.flatten().to_numpy()
                m = 100 - 75 + 75 * n * n_docs // n_terms
                term = terms.flatten().to_numpy().astype(np.int64)
                gains = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, np.diff(ends, prepend=0))))
                index, ids = BlockIndex(ends, term, gains), ids.to_numpy()
                if len(index.terms) == 0:
                    continue
                for no, own, times in wanted:
                    rows = np.minimum(np.searchsorted(index.terms, own), len(index.terms) - 1)
                    here = index.terms[rows] == own
                    if here.any():
                        found[no] = index.best(rows[here], times[here], k, ids, found[no])
        for no, (scores, ids) in found.items():
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), no)), pa.array(ids), pa.array(scores)], schema.names)

    return matched.mapInArrow(run, schema)


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = 10, text: str = "text", doc_id: str = "doc_id",
    item_text: str = "text", item_id: str = "item_id", part_bytes: int = PART_BYTES,
) -> DataFrame:
    """The ``k`` documents with the highest score above 0 for each item: the item's id, ``rank``
    from 1, the document's id and ``score``. Equal scores go by ascending id.

    Terms are runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z in
    lower case. With N documents that have a term, L terms in all, n terms in a document, df
    documents that hold a term and tf times it is there, the term's weight is
    floor(1000 ln((2 N + 2) / (2 df + 1))), a document's length measure m is 25 + 75 n N div L, and a
    score adds weight * (10^9 tf div (1000 tf + 8 m)) over the item's terms, repeats included.

    One pass over the documents writes what they hold of the items' terms. In the next, each block of
    documents has a bitmap for each term; the bitmaps of an item's terms, read across, give each
    document's mask, and masks are scored by descending bound until no other can reach the best ``k``.
    Only the best ``k`` of each partition are shuffled. Items are taken in parts of ``part_bytes``
    bytes; the driver holds one part, and each part is two passes.

    A document with a NULL or empty text has no terms and is never found, a NULL id comes before all
    others. An item without terms gives no rows. Repeated rows of documents are found each; repeated
    items give rows each. Empty tables give an empty table. Ids of documents are integers; columns
    beyond these are not read.
    """
    spark = docs.sparkSession
    ready = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    # A NULL id travels as the least number, so that arrays of ids hold numbers only.
    ready = ready.withColumn("id", F.coalesce("id", F.lit(-(1 << 63)).cast("long")))
    wanted = items.select(F.col(item_id).alias("id"), F.coalesce(F.col(item_text), F.lit("")).cast("binary").alias("text"))
    names = [item_id, *fresh(items.select(item_id), "rank", doc_id, "score")]
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", items.schema[item_id].dataType)])
    out = spark.createDataFrame([], T.StructType([
        T.StructField(names[0], items.schema[item_id].dataType), T.StructField(names[1], T.IntegerType()),
        T.StructField(names[2], T.LongType()), T.StructField(names[3], T.LongType())]))
    for part in _parts(wanted, part_bytes):
        counted = [Counter(terms_of(bytes(row.text))) for row in part]
        vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for c in counted for t in c))}
        if not vocabulary:
            continue
        matched = materialize(_matched(ready, vocabulary))
        n_docs, n_terms = matched.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if n_docs == 0:
            break
        # At most one row for each term of the part.
        df = dict(matched.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(vocabulary))], np.int64)
        numbers = [(no, [vocabulary[t] for t in c], list(c.values())) for no, c in enumerate(counted) if c]
        found = _search(matched, numbers, weights, n_docs, n_terms, k)
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "id"))
        ids = spark.createDataFrame([(no, row.id) for no, row in enumerate(part)], schema)
        found = found.withColumn("rank", place).where(F.col("rank") <= k).join(ids, "item")
        found = found.withColumn("id", F.when(F.col("id") > -(1 << 63), F.col("id")))
        out = out.union(found.select("item_id", F.col("rank").cast("int"), "id", "score"))
    return out
