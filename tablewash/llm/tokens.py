"""Tokens of whole texts: counts of any length of text, and ids, as the tokenizer library gives them."""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewash.llm.common import Remembered, fresh, map_batches

#: Texts of more characters are encoded in overlapping pieces.
PIECE, OVERLAP = 65_536, 256
#: Bytes a word cache takes, about; a full cache drops its older half. It only saves time.
CACHED = 300 << 20


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    """The tokenizer of a .json file, single-threaded, with its defaults for special strings."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _plain_letters(word: str) -> bool:
    """Letters that stay letters in lower case and normal form, so that a sign behind them stands alone."""
    return word.isalpha() and (word.isascii() or word.lower().isalpha() and unicodedata.is_normalized("NFC", word))


class WordCache(Remembered):
    """What the library makes of a word, encoded when first asked for and then remembered. ``make``
    turns the ids of a word into what is kept; what it gives for two parts is added up. A word of
    letters and one sign behind them is put together from its parts, which many words share."""

    def __init__(self, path: str, make: Callable[[list[int]], object]):
        super().__init__(CACHED)
        self.tokenizer, self.make = load_tokenizer(path), make
        normalizer = self.tokenizer.normalizer
        self.folds = normalizer is not None and normalizer.normalize_str("A") == "a"
        #: Special strings match the text as it stands, so a word with one in any letter case is not folded.
        self.added = tuple(t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values())

    def __missing__(self, word: str):
        value = self.work_out(word)
        if len(word) <= self.longest:
            if self.held > self.limit:
                self.trim()
            self.learn(word, value)
        return value

    def work_out(self, word: str):
        body = word[1:] if word[:1] == " " else word
        if self.folds and word.isascii() and word != (low := word.lower()) and not any(a in low for a in self.added):
            return self[low]
        if len(body) > 1 and body[-1] in ".,;:!?*#$%&|" and _plain_letters(body[:-1]):
            return self[word[:-1]] + self[body[-1]]
        return self.make(self.tokenizer.encode(word, add_special_tokens=False).ids)


# Counting ----------------------------------------------------------------------------------------

#: A space between two characters that are no white space: there a byte-level pattern always starts
#: a new word, so the parts can be encoded apart.
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_ODD = re.compile(r"[^\S \n]|  | \n|\n ")


def safe_parts(text: str) -> list[str]:
    """``text`` cut before spaces at which no token can reach across; the parts join to the text."""
    if _ODD.search(text):
        head, *rest = _SAFE.split(text)
    else:
        head, *rest = text.split(" ")
    return [head, *[" " + r for r in rest]]


def count_tokens_spliced(tokenizer, text: str, piece: int = PIECE, overlap: int = OVERLAP) -> int:
    """Tokens of a text of any length. Pieces that overlap are encoded with offsets; two neighbours
    are joined at a place inside their overlap where both start a word after white space and give
    the same tokens to the end of the left one's trusted part. If no place is found the overlap is
    doubled, up to the whole text.

    A join at place p is proven when both encodings have a token boundary at p, the character at p is
    a space between two other characters, which starts a word in any context, and the tokens from p
    to the next such place agree. What lies before p is then counted on the left, the rest on the right.
    """
    total, start, skip = 0, 0, 0
    while True:
        end = min(len(text), start + piece)
        if end == len(text):
            return total + _tokens_from(_spans(tokenizer, text[start:end]), skip)
        reach = overlap
        while True:
            left_end = min(len(text), end + reach)
            right_start = max(start, end - reach)
            left = _spans(tokenizer, text[start:left_end])
            if left_end == len(text):
                return total + _tokens_from(left, skip)
            right = _spans(tokenizer, text[right_start : min(len(text), right_start + piece + reach)])
            p = _stable_place(text, left, start, left_end, right, right_start)
            if p is not None and p > start + skip:
                break
            reach *= 2
        total += sum(1 for a, _, _ in left if start + skip <= start + a < p)
        start, skip = right_start, p - right_start


def _spans(tokenizer, text: str) -> list[tuple[int, int, int]]:
    e = tokenizer.encode(text, add_special_tokens=False)
    return [(a, b, i) for (a, b), i in zip(e.offsets, e.ids)]


def _tokens_from(spans: list[tuple[int, int, int]], skip: int) -> int:
    return sum(1 for a, _, _ in spans if a >= skip)


def _stable_place(text, left, left_start, left_end, right, right_start) -> int | None:
    """The first safe place of the overlap from which both sides agree up to the next safe place.
    The outer quarters of the overlap, next to where a side was cut, are not trusted."""
    width = left_end - right_start
    low, high = right_start + width // 4, left_end - width // 4
    a = {left_start + s: (left_start + e, i) for s, e, i in left if low <= left_start + s < high and e > s}
    b = {right_start + s: (right_start + e, i) for s, e, i in right if low <= right_start + s < high and e > s}
    places = [p for p in range(max(low, 1), min(high, len(text) - 1))
              if text[p] == " " and p in a and p in b and not text[p - 1].isspace() and not text[p + 1].isspace()]
    for p, following in zip(places, places[1:]):
        run_a = [(s, a[s]) for s in range(p, following) if s in a]
        if run_a == [(s, b[s]) for s in range(p, following) if s in b]:
            return p
    return None


def count_tokens(
    df: DataFrame, path: str, text: str = "text", out: str = "n_tokens", keep_text: bool = True
) -> DataFrame:
    """``df`` with the number of tokens of each whole text under the byte-level tokenizer at
    ``path``, as the library counts them without added special tokens; special strings inside a
    text are read as its default has it. Without ``keep_text`` the texts are not handed back.

    Texts up to ``PIECE`` characters are cut at spaces no token reaches across, and the words'
    counts are remembered per worker. Longer texts go through ``count_tokens_spliced``, which
    holds one piece at a time.

    A NULL or empty text has 0 tokens. Repeated rows count each. An empty table gives an empty table.
    A column named ``out`` is replaced; other columns are carried along.
    """
    rest = df.drop(out) if keep_text else df.drop(out, text)
    (whole,) = fresh(df, "whole_text")
    schema = rest.withColumn(out, F.lit(0).cast("long")).schema

    def make():
        count = _counter(path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts = pa.array(count(batch.column(batch.num_columns - 1)), pa.int64())
            return pa.RecordBatch.from_arrays([*batch.columns[:-1], counts], schema.names)

        return step

    ready = df.select(*rest.columns, F.coalesce(F.col(text), F.lit("")).alias(whole))
    return map_batches(ready, make, schema)


@lru_cache(maxsize=2)
def _counter(path: str) -> Callable[[pa.Array], list[int]]:
    words = WordCache(path, len)

    def count(column: pa.Array) -> list[int]:
        out = []
        for at in range(0, len(column), 256):
            texts = column.slice(at, 256).to_pylist()
            parts = [safe_parts(t) if 0 < len(t) <= PIECE else [] for t in texts]
            get = words.__getitem__
            for t, p in zip(texts, parts):
                out.append(count_tokens_spliced(words.tokenizer, t) if len(t) > PIECE else sum(map(get, p)))
        return out

    return count
