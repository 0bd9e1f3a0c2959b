"""Packing token streams into sequences, in order, with cuts chosen by dynamic programming."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from struct import pack as packed

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewash.llm.common import fresh
from tablewash.llm.tokens import WordCache
from tablewash.llm.trie_bpe import byte_symbols

#: What a cut costs, in tokens of padding: behind a sentence, or inside one. Behind a document it is free.
SENTENCE, INSIDE = 2, 16
#: Inside a stretch without sentence ends that is longer than LONG, every STEP tokens may be cut.
LONG, STEP = 64, 16
#: Sequences that are planned together.
PLANNED = 256
SENTENCE_ENDS = ".!?"


def choose_cuts(places: list[int], costs: list[int], length: int) -> tuple[list[int], list[int]]:
    """For each place the least cost of cutting there, and the place cut before it on the cheapest way.

    ``places`` ascend from the start of the first sequence; no two neighbours are more than
    ``length`` apart. cost(j) = min over i with places[j] - places[i] <= length of cost(i) + padding
    + costs[j], where padding = length - (places[j] - places[i]). With g = cost + place the
    minimum is over g alone, so a queue of rising g gives each transition in constant time.
    """
    n = len(places)
    g, back = [places[0]] * n, [0] * n
    queue, head = [0], 0
    for j in range(1, n):
        low = places[j] - length
        while places[queue[head]] < low:
            head += 1
        back[j] = queue[head]
        v = g[queue[head]] + length + costs[j]
        g[j] = v
        while len(queue) > head and g[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    return [v - p for v, p in zip(g, places)], back


def way(back: list[int], last: int) -> list[int]:
    out = [last]
    while out[-1]:
        out.append(back[out[-1]])
    return out[::-1]


def cut_places(document_ends: np.ndarray, sentence_ends: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Where ``total`` tokens may be cut, and what a cut costs."""
    document_ends = document_ends[(document_ends >= 0) & (document_ends <= total)]
    cost = np.full(total + 1, 255, np.uint8)
    cost[sentence_ends] = SENTENCE
    cost[[0, total]] = SENTENCE
    cost[document_ends] = 0
    sure = np.flatnonzero(cost != 255)
    gaps = np.diff(sure)
    wide = np.flatnonzero(gaps > LONG)
    count = (gaps[wide] - 1) // STEP
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + 1
    cost[np.repeat(sure[wide], count) + nth * STEP] = INSIDE
    places = np.flatnonzero(cost != 255)
    return places, cost[places].astype(np.int64)


def power_sizes(n: int) -> list[int]:
    """``n`` as powers of two, the largest first: sequences that need no padding."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


class Packer:
    """Takes documents in order and gives pieces of sequences. Holds the tokens of at most about
    ``PLANNED`` sequences and of one document."""

    def __init__(self, length: int, ends_sentence: np.ndarray, first_id: int):
        self.length, self.ends_sentence, self.sequence = length, ends_sentence, first_id
        self.ids, self.rows, self.held = [], [], 0
        self.done = 0  # tokens of the first held document that are in earlier sequences

    def add(self, row: int, ids: np.ndarray) -> Iterator[dict]:
        self.ids.append(ids)
        self.rows.append(row)
        self.held += len(ids)
        if self.held - self.done >= PLANNED * self.length:
            yield self.plan(False)

    def finish(self) -> Iterator[dict]:
        if self.held > self.done:
            yield self.plan(True)

    def plan(self, last: bool) -> dict:
        """Cut what is held. All but the last plan leave the tokens behind the cheapest cut near the
        end to the next one; the last cuts the rest into powers of two."""
        sizes = np.array([len(x) for x in self.ids])
        ids = np.concatenate(self.ids)[self.done :]
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) - self.done  # the first may be negative
        total = len(ids)
        places, costs = cut_places(starts + sizes, np.flatnonzero(self.ends_sentence[ids]) + 1, total)
        cost, back = choose_cuts(places.tolist(), costs.tolist(), self.length)
        near = np.flatnonzero(places >= total - self.length)
        if last:
            rest = [INSIDE * max(0, len(power_sizes(int(total - places[j]))) - 1) for j in near]
            at = near[int(np.argmin(np.array([cost[j] for j in near]) + rest))]
        else:
            at = near[int(np.argmin([cost[j] for j in near]))]
        cuts = places[way(back, int(at))]
        if last:
            tail = np.cumsum([0, *power_sizes(int(total - cuts[-1]))]) + cuts[-1]
            cuts = np.concatenate([cuts, tail[1:]])
        end = int(cuts[-1])
        edges = np.sort(np.concatenate([cuts, starts[(starts > 0) & (starts < end)]]))
        edges = edges[np.diff(edges, prepend=-1) > 0]
        begin = edges[:-1]
        doc = np.searchsorted(starts, begin, "right") - 1
        seq = np.searchsorted(cuts, begin, "right") - 1
        out = {
            "row": np.array(self.rows)[doc], "start": begin - starts[doc], "length": np.diff(edges),
            "doc_tokens": sizes[doc], "sequence_id": self.sequence + seq, "offset": begin - cuts[seq],
            "ids": ids[:end], "edges": edges,
        }
        self.sequence += len(cuts) - 1
        first = int(np.searchsorted(starts, end, "right")) - 1 if end < total else len(self.ids)
        self.done = end - int(starts[first]) if end < total else 0
        self.ids, self.rows = self.ids[first:], self.rows[first:]
        self.held = sum(len(x) for x in self.ids)
        return out


def pack(df: DataFrame, path: str, length: int = 2048, end_id: int = 1, text: str = "text") -> DataFrame:
    """Pack the texts of ``df`` into sequences of at most ``length`` tokens of the tokenizer at
    ``path``; each document is its ids, then ``end_id``. One row per piece of a document in a
    sequence: the columns of ``df`` but the text, ``start`` (the document's ids before the piece),
    ``length``, ``ids`` (little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id`` and ``offset``.

    The order of rows inside a partition is kept, and each partition is packed on its own, so that
    nothing is shuffled: at 100 TB a partition of 128 MB fills thousands of sequences and leaves
    at most a few short ones, which have sizes of powers of two and need no padding.

    Documents are cut behind documents and sentences where that costs little padding. A NULL or
    empty text is ``end_id`` alone. Very long texts are spread over sequences. Repeated rows are
    packed each. An empty table gives an empty table. Columns of ``df`` named like an output column
    are left out.
    """
    added = {"start": "long", "length": "long", "ids": "binary", "doc_tokens": "long", "sequence_id": "long", "offset": "long"}
    kept = [c for c in df.columns if c not in (text, *added)]
    (whole,) = fresh(df, "whole_text")
    ready = df.select(*kept, F.coalesce(F.col(text), F.lit("")).alias(whole))
    schema = T.StructType(df.select(*kept).schema.fields + [T.StructField(k, T.BinaryType() if v == "binary" else T.LongType()) for k, v in added.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, held, base = None, None, [], 0
        for batch in batches:
            if packer is None:
                encode, ends = _encoder(path, end_id)
                packer = Packer(length, ends, TaskContext.get().partitionId() << 33)
            held.append(pa.Table.from_batches([batch]).drop_columns([whole]) if kept else
                        pa.table({whole: pa.nulls(batch.num_rows, pa.bool_())}))
            row = base
            for at in range(0, batch.num_rows, 256):
                for ids in encode(batch.column(batch.num_columns - 1).slice(at, 256).to_pylist()):
                    for plan in packer.add(row, ids):
                        yield from _pieces(plan, held, base - _rows(held[:-1]), schema)
                    row += 1
            base += batch.num_rows
            held = _needed(held, base, packer.rows[0] if packer.rows else base)
        if packer is not None:
            for plan in packer.finish():
                yield from _pieces(plan, held, base - _rows(held), schema)

    return ready.mapInArrow(run, schema)


def _rows(tables: list) -> int:
    return sum(t.num_rows for t in tables)


def _needed(tables: list, base: int, first: int) -> list:
    """The tables that hold the rows from ``first`` on; ``base`` is the number behind the last row."""
    while tables and base - _rows(tables[1:]) <= first:
        tables = tables[1:]
    return tables


def _pieces(plan: dict, held: list, base: int, schema: T.StructType) -> Iterator[pa.RecordBatch]:
    table = pa.concat_tables(held).take(pa.array(plan["row"] - base))
    table = table.select(schema.names[: len(schema) - 6])
    n = len(plan["row"])
    ids = pa.Array.from_buffers(pa.binary(), n, [
        None, pa.py_buffer((plan["edges"] * 4).astype(np.int32).tobytes()), pa.py_buffer(plan["ids"].astype("<u4").tobytes())])
    for name in ("start", "length", "ids", "doc_tokens", "sequence_id", "offset"):
        values = ids if name == "ids" else pa.array(plan[name].astype(np.int64))
        table = table.append_column(name, values) if table.num_columns else pa.table({name: values})
    yield from table.combine_chunks().to_batches()


#: Letters that are one character in lower case and normal form; their lower case is among them.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ʯⱥⱦ"
_SIGNS = r"!-/:-@\[-`{-~"
_ODD = re.compile(rf"[^{_LETTERS}0-9{_SIGNS} \t\r]")
#: The parts of a text in lower case that has nothing odd.
_PARTS = re.compile(rf"[{_LETTERS}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[{_SIGNS}]+")
#: How a tokenizer prepares and cuts its text, for the parts to be what it cuts.
_PREPARES = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_CUTS = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


class PartIds(WordCache):
    """Ids, little-endian unsigned 32-bit, of the strings that ``cut`` makes of a text. Many words share
    a part, and nothing is left to prepare or cut in it, so the library's model alone encodes it. A
    string that starts with a space is a whole word, for which the whole library is asked."""

    def __init__(self, path: str):
        super().__init__(path, lambda ids: packed(f"<{len(ids)}I", *ids))
        steps = (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)
        known = [s is not None and json.loads(s.__getstate__()) for s in steps] == [_PREPARES, _CUTS]
        self.model = self.tokenizer.model if known else None
        self.symbols = byte_symbols()

    def cut(self, text: str) -> list[str]:
        """Strings whose ids make up those of ``text``: its parts, and whole words with something odd.
        All words are whole where the tokenizer is of another kind or the text may have special strings."""
        text = text.replace("\n", " ")
        low = text.lower()
        if self.model is None or any(a in low for a in self.added):
            return [" " + w for w in text.split(" ") if w]
        odd = _ODD.search(text)
        if odd is None:
            return _PARTS.findall(low)
        out, at = [], 0
        while odd:
            start = text.rfind(" ", at, odd.start()) + 1 or at
            end = text.find(" ", odd.end())
            end = len(text) if end < 0 else end
            out += _PARTS.findall(text[at:start].lower())
            out.append(" " + text[start:end])
            at, odd = end, _ODD.search(text, end)
        return out + _PARTS.findall(text[at:].lower())

    def work_out(self, word: str) -> bytes:
        if self.model is None or word[:1] == " " or word in self.added:
            return super().work_out(word)
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.symbols)
        return self.make([t.id for t in self.model.tokenize(shown)])


_ENCODERS: dict = {}


def _encoder(path: str, end_id: int):
    """A function from texts to their ids, and which ids end a sentence. The tokenizer drops white
    space, so words are encoded apart and remembered per worker."""
    if path not in _ENCODERS:
        words = PartIds(path)
        vocabulary = words.tokenizer.get_vocab()
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            bare = token.removesuffix("</w>")
            ends[i] = bool(bare) and set(bare) <= set(SENTENCE_ENDS)
        _ENCODERS[path] = (words, ends)
    words, ends = _ENCODERS[path]
    tail = np.array([end_id], "<u4").tobytes()

    def encode(texts: list[str]) -> Iterator[np.ndarray]:
        get = words.__getitem__
        for t in texts:
            yield np.frombuffer(b"".join([*map(get, words.cut(t)), tail]), "<u4")

    return encode, ends
