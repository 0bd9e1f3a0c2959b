"""Alignment of the tokens of two tokenizers, and how often pairs of ids are aligned in the corpus."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewash.llm.common import fresh, materialize
from tablewash.llm.tokens import safe_parts
from tablewash.llm.trie_bpe import byte_symbols

#: Documents of a block; a bitmap has one bit for each. A block also ends after so many characters.
BLOCK, BLOCK_CHARS = 4096, 1 << 23
_FULL = BLOCK // 8
#: What a worker remembers of pieces of text, in bytes, between blocks.
REMEMBERED = 256 << 20
#: Links of one call that are written out one by one; more are first counted per distinct ids.
EXPANDED = 1 << 22

MEASURES = ["n_a", "n_b", "n_groups", "n_links"]


# Bitmaps -----------------------------------------------------------------------------------------


def pack(slots: np.ndarray) -> bytes:
    """A bitmap of ascending document slots: as 16-bit slots where these take less, else one bit each."""
    if 2 * len(slots) < _FULL:
        return slots.astype("<u2").tobytes()
    bits = np.zeros(BLOCK, bool)
    bits[slots] = True
    return np.packbits(bits, bitorder="little").tobytes()


def unpack(bitmap: bytes) -> np.ndarray:
    if len(bitmap) < _FULL:
        return np.frombuffer(bitmap, "<u2")
    return np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little"))


def popcount(bitmap: Column) -> Column:
    """Documents of a bitmap, in Spark."""
    return F.when(F.octet_length(bitmap) < _FULL, (F.octet_length(bitmap) / 2).cast("long")).otherwise(F.bitmap_count(bitmap))


# Pieces of text ----------------------------------------------------------------------------------


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of runs that begin at ``starts``, one run after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def _summed(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their weights."""
    if len(key) == 0:
        return key, weight
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(weight[order], first)


class Growing:
    """An array that grows at its end; beyond the range of its type it raises."""

    def __init__(self, dtype, *shape: int):
        self.held, self.size = np.zeros((1024, *shape), dtype), 0

    def __len__(self) -> int:
        return self.size

    def append(self, values: np.ndarray) -> None:
        if len(values) and int(values.max()) > np.iinfo(self.held.dtype).max:
            raise OverflowError(f"a piece of text with {values.max()} tokens or links")
        if self.size + len(values) > len(self.held):
            more = np.zeros((max(len(values), len(self.held) // 2), *self.held.shape[1:]), self.held.dtype)
            self.held = np.concatenate([self.held, more])
        self.held[self.size : self.size + len(values)] = values
        self.size += len(values)

    def all(self) -> np.ndarray:
        return self.held[: self.size]


class Aligner:
    """Aligns pieces of text and remembers them. A text is cut before single spaces between two other
    characters: there a token of either tokenizer ends, so no group reaches across."""

    def __init__(self, byte_path: str, piece_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError(f"{piece_path} has pieces that reach across words")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.space_b = self.b.piece_to_id("▁")
        byte_of = {s: b for b, s in byte_symbols().items()}
        with open(byte_path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(byte_of[c] for c in token)
        if len(self.bytes_a) * len(self.bytes_b) >= 1 << 32:
            raise ValueError("the pairs of ids do not fit into 32 bits")
        self.size_a = np.array(list(map(len, self.bytes_a)))
        self.size_b = np.array(list(map(len, self.bytes_b)))
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.texts: list[bytes | None] = []
        self.measures, self.starts, self.counts = Growing(np.int32, 4), Growing(np.int64), Growing(np.int32)
        self.codes, self.times = Growing(np.uint32), Growing(np.int32)
        self.held = 0

    def learn(self, pieces: list[str]) -> None:
        """Align distinct new pieces, each a space and what follows it."""
        raw = [p.encode() for p in pieces]
        a = [e.ids for e in self.a.encode_batch_fast(pieces, add_special_tokens=False)]
        # The model puts a space before a text, but not before an empty one.
        b = [y or [self.space_b] for y in self.b.encode([p[1:] for p in pieces], num_threads=1)]
        get_a, get_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        fine = [b"".join(map(get_a, x)) == r == b"".join(map(get_b, y)) for x, y, r in zip(a, b, raw)]
        texts: list[bytes | None] = [None] * len(pieces)
        measures = np.zeros((len(pieces), 4), np.int64)
        counts = np.zeros(len(pieces), np.int64)
        at = np.flatnonzero(fine)
        if len(at):
            own_a, own_b = [a[i] for i in at], [b[i] for i in at]
            measures[at, 0], measures[at, 1] = list(map(len, own_a)), list(map(len, own_b))
            ids_a = np.fromiter(chain.from_iterable(own_a), np.int64)
            ids_b = np.fromiter(chain.from_iterable(own_b), np.int64)
            ends_a, ends_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
            common = np.intersect1d(ends_a, ends_b, assume_unique=True)
            group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
            n_a, n_b = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
            # Pieces end where both have a token that ends, so each has whole groups.
            piece = np.searchsorted(np.cumsum([len(raw[i]) for i in at]), common)
            measures[at, 2] = np.bincount(piece, minlength=len(at))
            first = np.concatenate([[0], np.cumsum(measures[at, 2])])
            measures[at, 3] = np.add.reduceat(n_a * n_b, first[:-1])
            group, code, times = self._links(ids_a, group_a, n_a, ids_b, group_b, n_b)
            key, times = _summed(piece[group].astype(np.uint64) << np.uint64(32) | code, times)
            counts[at] = np.bincount((key >> np.uint64(32)).astype(np.int64), minlength=len(at))
            self.starts.append(len(self.codes) + np.cumsum(counts) - counts)
            self.codes.append(key & np.uint64(0xFFFFFFFF))
            self.times.append(times)
            told = self._told(ids_a, n_a, ids_b, n_b)
            for i, x, y in zip(at.tolist(), first.tolist(), first[1:].tolist()):
                texts[i] = ";".join(told[x:y]).encode()
            self.held += 8 * len(key)
        else:
            self.starts.append(counts)
        base = len(self.texts)
        self.known.update(zip(pieces, range(base, base + len(pieces))))
        self.texts += texts
        self.measures.append(measures)
        self.counts.append(counts)
        self.held += sum(map(len, pieces)) + sum(len(t or b"") for t in texts) + 280 * len(pieces)

    def _links(self, ids_a, group_a, n_a, ids_b, group_b, n_b):
        """Group, pair of ids and number of links; a pair may come more than once."""
        times_a, times_b = np.ones(len(ids_a), np.int64), np.ones(len(ids_b), np.int64)
        if int((n_a * n_b).sum()) > EXPANDED:
            wide = np.uint64(32)
            key_a, times_a = _summed(group_a.astype(np.uint64) << wide | ids_a.astype(np.uint64), times_a)
            key_b, times_b = _summed(group_b.astype(np.uint64) << wide | ids_b.astype(np.uint64), times_b)
            group_a, ids_a = (key_a >> wide).astype(np.int64), (key_a & np.uint64(0xFFFFFFFF)).astype(np.int64)
            group_b, ids_b = (key_b >> wide).astype(np.int64), (key_b & np.uint64(0xFFFFFFFF)).astype(np.int64)
            n_b = np.bincount(group_b, minlength=len(n_b))
        start_b = np.cumsum(n_b) - n_b
        reps = n_b[group_a]
        from_a, from_b = np.repeat(np.arange(len(ids_a)), reps), _runs(start_b[group_a], reps)
        code = ids_a[from_a].astype(np.uint64) * np.uint64(len(self.bytes_b)) + ids_b[from_b].astype(np.uint64)
        return group_a[from_a], code, times_a[from_a] * times_b[from_b]

    @staticmethod
    def _told(ids_a, n_a, ids_b, n_b) -> list[str]:
        """The groups as text: ``a1,a2|b1``."""
        a, b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
        end_a, end_b = np.cumsum(n_a).tolist(), np.cumsum(n_b).tolist()
        out, i, k = [], 0, 0
        for j, m in zip(end_a, end_b):
            out.append(f"{a[i] if j == i + 1 else ','.join(a[i:j])}|{b[k] if m == k + 1 else ','.join(b[k:m])}")
            i, k = j, m
        return out

    def tables(self):
        """Measures of the known pieces, where their links start, how many these are, their pairs and numbers."""
        return self.measures.all(), self.starts.all(), self.counts.all(), self.codes.all(), self.times.all()


@lru_cache(maxsize=1)
def _aligner(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, piece_path)


# Documents ---------------------------------------------------------------------------------------


class Block:
    """Documents that share bitmaps."""

    def __init__(self, aligner: Aligner):
        self.aligner = aligner
        self.size, self.chars = 0, 0
        self.measures: list[np.ndarray] = []
        self.digests: list[str] = []
        self.keys, self.links = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]

    def add(self, texts: list[str]) -> None:
        """Align some hundred texts and count their links by pair of ids and document."""
        known = self.aligner.known
        split = [[p for p in safe_parts(" " + t) if p] if t else [] for t in texts]
        new = list(set(chain.from_iterable(split)) - known.keys())
        if new:
            self.aligner.learn(new)
        told, pieces = self.aligner.texts, []
        for s in split:
            own = list(map(known.__getitem__, s))
            groups = list(map(told.__getitem__, own))
            if not groups or None in groups:  # a piece whose tokens do not give its bytes
                own, digest = [], ""
            else:
                digest = hashlib.sha256(b";".join(groups)).hexdigest()
            pieces.append(own)
            self.digests.append(digest)
        measures, starts, counts, codes, times = self.aligner.tables()
        sizes = np.array(list(map(len, pieces)), np.int64)
        every = np.fromiter(chain.from_iterable(pieces), np.int64, int(sizes.sum()))
        sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(measures[every], axis=0, dtype=np.int64)])
        ends = np.cumsum(sizes)
        self.measures.append(sums[ends] - sums[ends - sizes])
        key, often = _summed(np.repeat(np.arange(len(sizes)) + self.size, sizes) << 32 | every, np.ones(len(every), np.int64))
        piece = key & 0xFFFFFFFF
        n = counts[piece].astype(np.int64)
        at = _runs(starts[piece], n)
        doc = np.repeat((key >> 32).astype(np.uint64), n)
        key, links = _summed(codes[at].astype(np.uint64) << np.uint64(16) | doc, times[at].astype(np.int64) * np.repeat(often, n))
        self.keys.append(key)
        self.links.append(links)
        self.size += len(texts)
        self.chars += sum(map(len, texts))

    def full(self) -> bool:
        return self.size >= BLOCK or self.chars >= BLOCK_CHARS

    def finish(self) -> tuple[np.ndarray, Iterator[tuple[list[int], list[bytes], list[list[bytes]]]]]:
        """The documents' measures, and the postings: pairs, bitmaps of documents, planes."""
        key, links = np.concatenate(self.keys), np.concatenate(self.links)
        order = np.argsort(key)
        return np.concatenate([np.zeros((0, 4), np.int64), *self.measures]), _postings(key[order], links[order])


def _postings(key: np.ndarray, links: np.ndarray) -> Iterator[tuple[list[int], list[bytes], list[list[bytes]]]]:
    """Pairs with a bitmap of their documents and, for pairs that a document links more than once,
    bitmaps of the bits of the number of links less one."""
    code, slot = key >> np.uint64(16), (key & np.uint64(0xFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    ends = np.concatenate([first[1:], [len(code)]])
    most = np.maximum.reduceat(links, first) if len(first) else first
    small = slot.astype("<u2").tobytes()
    for at in range(0, len(first), 20_000):
        pairs, bitmaps, planes = code[first[at : at + 20_000]].astype(np.int64).tolist(), [], []
        for i, j, m in zip(first[at : at + 20_000].tolist(), ends[at : at + 20_000].tolist(), most[at : at + 20_000].tolist()):
            bitmaps.append(small[2 * i : 2 * j] if 2 * (j - i) < _FULL else pack(slot[i:j]))
            if m == 1:
                planes.append([])
            else:
                extra = links[i:j] - 1
                planes.append([pack(slot[i:j][(extra >> k & 1) == 1]) for k in range((m - 1).bit_length())])
        yield pairs, bitmaps, planes


def _blocks(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """One row for each document (``a`` is null) and one for each pair of ids in a block of documents.
    Columns of ``docs`` travel as ``row``; the text is the last column."""
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("slot", T.IntegerType()), T.StructField("row", docs.schema["row"].dataType),
        *[T.StructField(m, T.LongType()) for m in MEASURES], T.StructField("groups_sha256", T.StringType()),
        T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("docs", T.BinaryType()),
        T.StructField("planes", T.ArrayType(T.BinaryType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(byte_path, piece_path)
        if aligner.held > REMEMBERED:
            aligner.forget()
        number, block, rows, kinds = TaskContext.get().partitionId() << 32, Block(aligner), [], None
        row_type = None

        def done():
            measures, postings = block.finish()
            n = len(measures)
            yield _batch(kinds, n, {
                "block": pa.array(np.full(n, number)), "slot": pa.array(np.arange(n, dtype=np.int32)),
                "row": pa.concat_arrays(rows), "groups_sha256": pa.array(block.digests, pa.string()),
                **{m: pa.array(measures[:, i]) for i, m in enumerate(MEASURES)}})
            width = len(aligner.bytes_b)
            for pairs, bitmaps, planes in postings:
                code = np.array(pairs, np.int64)
                yield _batch(kinds, len(pairs), {
                    "block": pa.array(np.full(len(pairs), number)), "a": pa.array((code // width).astype(np.int32)),
                    "b": pa.array((code % width).astype(np.int32)), "docs": pa.array(bitmaps, pa.binary()),
                    "planes": pa.array(planes, kinds["planes"])})
            if aligner.held > REMEMBERED:
                aligner.forget()

        for batch in batches:
            if kinds is None:
                row_type = batch.column(0).type
                kinds = {
                    "block": pa.int64(), "slot": pa.int32(), "row": row_type, **{m: pa.int64() for m in MEASURES},
                    "groups_sha256": pa.string(), "a": pa.int32(), "b": pa.int32(), "docs": pa.binary(),
                    "planes": pa.list_(pa.field("element", pa.binary(), nullable=False))}
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows.append(part.column(0))
                block.add(part.column(1).to_pylist())
                if block.full():
                    yield from done()
                    number, block, rows = number + 1, Block(aligner), []
        if block.size:
            yield from done()

    return docs.mapInArrow(run, schema)


def _batch(kinds: dict[str, pa.DataType], n: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[k] if k in columns else pa.nulls(n, t) for k, t in kinds.items()], list(kinds))


def _scores(rows: DataFrame, kept: T.StructType) -> DataFrame:
    """Sum what the postings of a block give its documents. ``rows`` are partitioned and sorted by
    block, the documents of a block first."""
    schema = T.StructType([*kept.fields, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    names = [f.name for f in kept.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number, best, total = [], None, None, None

        def done():
            table = pa.Table.from_batches(held)
            slots = table.column("slot").to_numpy()
            out = table.select(names)
            out = out.append_column("n_best", pa.array(best[slots])).append_column("count_sum", pa.array(total[slots]))
            yield from out.combine_chunks().to_batches()

        for batch in batches:
            blocks = batch.column(batch.schema.get_field_index("block")).to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1], [True]]))
            for i, j in zip(edges.tolist(), edges[1:].tolist()):
                if blocks[i] != number:
                    if held:
                        yield from done()
                    held, number, best, total = [], blocks[i], np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)
                part = batch.slice(i, j - i)
                slots = part.column(part.schema.get_field_index("slot"))
                documents = part.filter(slots.is_valid())
                if documents.num_rows:
                    held.append(documents)
                _add(part.filter(slots.is_null()), best, total)
        if held:
            yield from done()

    return rows.mapInArrow(run, schema)


def _add(postings: pa.RecordBatch, best: np.ndarray, total: np.ndarray) -> None:
    if postings.num_rows == 0:
        return
    get = lambda name: postings.column(postings.schema.get_field_index(name))
    count, is_best = get("count").to_numpy(), get("best").to_numpy(zero_copy_only=False).astype(np.int64)
    bitmaps, planes = get("docs").to_pylist(), get("planes").to_pylist()
    maps = [*bitmaps, *[p for own in planes for p in own]]
    row = np.concatenate([np.arange(len(bitmaps)), np.array([i for i, own in enumerate(planes) for _ in own], np.int64)])
    weight = np.concatenate([np.ones(len(bitmaps), np.int64), np.array([1 << k for own in planes for k in range(len(own))], np.int64)])
    slots = list(map(unpack, maps))
    times = np.fromiter(map(len, slots), np.int64, len(slots))
    slots = np.concatenate(slots).astype(np.int64)
    np.add.at(total, slots, np.repeat(weight * count[row], times))
    np.add.at(best, slots, np.repeat(weight * is_best[row], times))


def _posting_counts(postings: DataFrame) -> DataFrame:
    """For each pair of ids its documents (``count``) and its links. Blocks hold different documents,
    so the OR of a pair's bitmaps is those of its blocks side by side, and popcounts add up."""
    here = popcount(F.col("docs"))
    further = F.aggregate(F.transform("planes", lambda p, k: popcount(p) * F.call_function("shiftleft", F.lit(1).cast("long"), k)), F.lit(0).cast("long"), lambda x, y: x + y)
    return postings.groupBy("a", "b").agg(F.sum(here).alias("count"), F.sum(here + further).alias("links"))


def _written(docs: DataFrame, byte_path: str, piece_path: str, text: str) -> tuple[DataFrame, DataFrame]:
    ready = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    done = materialize(_blocks(ready, byte_path, piece_path))
    return done.where("slot IS NOT NULL"), done.where("slot IS NULL")


def pair_counts(docs: DataFrame, byte_path: str, piece_path: str, text: str = "text") -> DataFrame:
    """For each pair of ids ``a``, ``b`` that some document links: ``count`` of documents and of ``links``.

    Documents without tokens (see ``align``) link nothing; a table without links gives no rows.
    """
    return _posting_counts(_written(docs, byte_path, piece_path, text)[1])


def align(docs: DataFrame, byte_path: str, piece_path: str, text: str = "text") -> DataFrame:
    """``docs`` with the alignment of each whole text's tokens under a byte-level tokenizer (A) and a
    sentencepiece model (B), both of a space and the text without special tokens.

    Tokens are grouped between byte offsets where tokens of both end. Each pair of an A and a B token
    of a group is a link. ``n_a``, ``n_b``, ``n_groups`` and ``n_links`` count them; ``groups_sha256``
    is the digest of the groups as text; ``count_sum`` adds up, over the links, the documents of the
    corpus that link the same ids; ``n_best`` counts the links whose documents are as many as those
    of any pair with the same A id.

    Each task numbers its documents in blocks and writes, for each pair of ids of a block, a
    compressed bitmap of the documents and planes of bits for how often they link it. Popcounts
    give the documents of a pair; joined back to the postings, they are summed into the documents
    of each block. What is shuffled is one row for each pair and block, however many documents and
    links it stands for, so a pair that every document has is no hot group; a block's postings are
    bounded by its characters or its one longest text.

    A NULL or empty text, or one that the joined tokens of A or B do not give back, has no tokens: zeros
    and an empty digest. Texts are aligned whole. Repeated rows are documents each. An empty table
    gives an empty table. Columns of ``docs`` named like an output column are left out.
    """
    added = [*MEASURES, "groups_sha256", "n_best", "count_sum"]
    carried = [c for c in docs.columns if c not in added]
    documents, postings = _written(docs.select(*carried, *([] if text in carried else [text])), byte_path, piece_path, text)
    counted = _posting_counts(postings).drop("links")
    counted = counted.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("a")))
    scored = postings.select("block", "a", "b", "docs", "planes").join(counted, ["a", "b"]).drop("a", "b")
    (row,) = fresh(docs, "row")
    kept = ["row", *MEASURES, "groups_sha256"]
    own = documents.select("block", "slot", *kept)
    rows = own.unionByName(scored, allowMissingColumns=True)
    rows = rows.repartition("block").sortWithinPartitions("block", F.col("slot").asc_nulls_last())
    out = _scores(rows, T.StructType([rows.schema[k] for k in kept]))
    return out.withColumnRenamed("row", row).select(*[F.col(row)[c].alias(c) for c in carried], *added)
