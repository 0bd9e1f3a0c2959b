"""What the corpus operators share: reading tables, row keys, word hashes of a batch of texts."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewash.session import materialize

__all__ = ["Remembered", "fresh", "let", "materialize", "map_batches", "read", "text_key", "word_hashes"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have yet, one for each of ``names``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text_key(text: Column) -> Column:
    """128 bits that stand for the text; NULL reads as the empty text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def map_batches(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, rows: int | None = None
) -> DataFrame:
    """``mapInArrow`` with one function made per task, so that what is costly to set up is set up once.
    With ``rows`` it gets, and hands on, at most so many rows at a time, which bounds what a worker holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in batches:
            step = step or make()
            for at in range(0, batch.num_rows, rows or max(1, batch.num_rows)):
                yield step(batch.slice(at, rows))

    return df.mapInArrow(run, schema)


# Hashes of words ---------------------------------------------------------------------------------

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
#: White space that ends a word: space and the five control characters from tab to carriage return.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _powers(n: int, base: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.ones(1, np.uint64)
    step = base & (2**64 - 1)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(step)])
        step = step * step & (2**64 - 1)
    return out[:n]


_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _table(kind: str, n: int) -> np.ndarray:
    if len(_POWERS[kind]) < n:
        _POWERS[kind] = _powers(1 << max(16, (n - 1).bit_length()), _P if kind == "up" else _P_INV)
    return _POWERS[kind]


_PART = 1 << 20


def text_parts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The texts of a batch as runs of neighbouring texts: first text, their bytes, their offsets.
    A run holds about 1 MB, or one text if that is longer, so that work arrays stay small."""
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _PART, "right")) - 1)
        last = min(last, len(column))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of neighbouring texts, and where each text's words start (one
    more entry than texts). A word is a run of bytes other than ASCII white space inside one text.

    The hash of a word is a polynomial in its bytes, taken as the difference of two prefix sums
    and shifted to the word's start, so that a whole batch is hashed by a few array operations.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[1:n] = inside[1:] != inside[:-1]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.concatenate([[False], inside])
    after = np.concatenate([inside, [False]])
    starts = np.flatnonzero(after & (edge | cut | ~before))
    ends = np.flatnonzero(before & (edge | cut | ~after))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _table("up", n)[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * _table("down", n)[starts]
    return mix(h + (ends - starts).astype(np.uint64)), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, in order; one hash of all words if they are fewer."""
    if len(words) == 0:
        return words
    size = min(size, len(words))
    out = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x2545F4914F6CDD1D) + words[k : len(words) - size + k + 1]
    return mix(out + np.uint64(size))


# What a worker remembers --------------------------------------------------------------------------


class Remembered(dict):
    """What was worked out for words, kept for later ones: about ``limit`` bytes at most between two
    calls of ``trim``, and then no word of more than ``longest`` characters. It only saves time."""

    def __init__(self, limit: int = 320 << 20, longest: int = 64):
        super().__init__()
        self.limit, self.longest, self.held, self.long = limit, longest, 0, []

    def learn(self, word: str, value) -> None:
        self[word] = value
        if len(word) > self.longest:
            self.long.append(word)
        else:
            self.held += _held(word, value)

    def trim(self) -> None:
        """Forget long words, and the older half of all when they take too much."""
        for word in self.long:
            self.pop(word, None)
        self.long = []
        if self.held > self.limit:
            for word in list(islice(self, len(self) // 2)):
                self.held -= _held(word, self.pop(word))


def _held(word: str, value) -> int:
    return sys.getsizeof(word) + sys.getsizeof(value) + 100
