"""BPE ids of whole texts and texts of ids: distinct words share the work on their common prefixes."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewash.llm.common import Remembered, fresh, map_batches
from tablewash.llm.tokens import load_tokenizer

_NEVER = 1 << 60
#: Remembered verdicts on pairs of tokens.
_PAIRS = 1 << 18
#: Texts whose new words are put into one trie.
_TOGETHER = 512


class PrefixTrie:
    """BPE of a vocabulary as a walk over prefixes.

    The encoding of a prefix is that of a shorter prefix and one last token. A token ``t`` that ends
    the prefix is that last token exactly if the last token ``p`` of what is left of it is not
    merged across the boundary when ``p`` and ``t`` stand next to each other. So one number for
    each prefix, its last token, is enough to read the encoding backwards.

    That holds where a merge never comes before those that make its parts and each token has one
    merge; both are checked here. ``merges`` are pairs of symbols, ``ids`` the ids of all symbols.
    """

    def __init__(self, ids: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.ids, self.suffix = ids, suffix
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(merges):
            left, right, whole = ids[a], ids[b], ids[a + b]
            if whole in self.made or any(x in ids and ids[x] not in self.made and len(x.removesuffix(suffix)) > 1 for x in (a, b)):
                raise ValueError(f"merge {r} ({a!r}, {b!r}) repeats a token or comes before its parts")
            self.rank[left, right] = r
            self.made[whole] = (left, right, r)
        #: Length of the longest token that ends in a symbol.
        self.longest: dict[str, int] = {}
        for token in ids:
            end = token.endswith(suffix) and token != suffix
            bare = token.removesuffix(suffix) if end else token
            key = bare[-1:] + suffix * end
            self.longest[key] = max(self.longest.get(key, 0), len(bare))
        self._left: dict[int, list] = {}
        self._right: dict[int, list] = {}
        self._whole: dict[int, bool] = {}
        self._meet: dict[int, bool] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The symbols that stand at one side of a token while it is made, each with the merge that ends it."""
        known = self._right if side else self._left
        if token not in known:
            out, until, at = [], _NEVER, token
            while True:
                out.append((at, until))
                if at not in self.made:
                    break
                *parts, until = self.made[at]
                at = parts[side]
            known[token] = out
        return known[token]

    def crossing(self, p: int, t: int) -> int | None:
        """The first merge across the boundary between two tokens. At equal rank the left pair goes first."""
        found = [m for x, x_until in self._edge(p, 1) for y, y_until in self._edge(t, 0)
                 if (m := self.rank.get((x, y))) is not None and m < x_until and m <= y_until]
        return min(found) if found else None

    def whole(self, t: int) -> bool:
        """Whether the text of ``t`` alone is encoded as ``t``."""
        ok = self._whole.get(t)
        if ok is None:
            if t in self.made:
                left, right, r = self.made[t]
                ok = self.whole(left) and self.whole(right) and self.crossing(left, right) == r
            else:
                ok = True
            self._whole[t] = ok
        return ok

    def meet(self, p: int, t: int) -> bool:
        """Whether ``p`` and ``t`` stay as they are next to each other."""
        key = p << 20 | t
        ok = self._meet.get(key)
        if ok is None:
            ok = self.whole(t) and self.crossing(p, t) is None
            if len(self._meet) >= _PAIRS:
                self._meet.clear()
            self._meet[key] = ok
        return ok

    def _last(self, word: str, d: int, suffix: str, last: list[int]) -> tuple[int, int]:
        """The last token of ``word[:d] + suffix`` and its length, given those of all shorter prefixes.
        Only one token fits, and short ones are the likelier."""
        get, known = self.ids.get, self._meet.get
        for size in range(1, min(d, self.longest.get(word[d - 1] + suffix, 1)) + 1):
            t = get(word[d - size : d] + suffix)
            if t is None:
                continue
            if size == d:
                ok = self.whole(t)
            else:
                ok = known(last[d - size] << 20 | t)
                if ok is None:
                    ok = self.meet(last[d - size], t)
            if ok:
                return t, size
        raise ValueError(f"no token for {word[d - 1] + suffix!r}")

    def encode(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Distinct words and their ids. Sorted words are the trie of the words, depth first: the
        path to a word keeps the states of the prefix it shares with the word before it, so a node
        that many words pass is worked out once, and one path is held at a time."""
        before, last, size = "", [0], [0]
        for word in sorted(words):
            n, shared = len(word), 0
            # The last symbol carries the suffix, so it is a leaf and no part of the path.
            for x, y in zip(before[:-1], word[: n - 1]):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], size[shared + 1 :]
            for d in range(shared + 1, n):
                t, k = self._last(word, d, "", last)
                last.append(t)
                size.append(k)
            t, k = self._last(word, n, self.suffix, last)
            out, d = [t], n - k
            while d:
                out.append(last[d])
                d -= size[d]
            yield word, out[::-1]
            before = word


#: Letters that are one character in lower case and normal form, single digits, runs of ASCII signs but the apostrophe.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
_PLAIN = re.compile(rf"[{_LETTERS}0-9!-&(-/:-@\[-`{{-~]*")
_WORDS = re.compile(rf"[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")


def byte_symbols() -> dict[int, str]:
    """The characters that byte-level vocabularies write for bytes: printable ones stand for themselves,
    the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class TrieEncoder:
    """Ids of texts under a byte-level BPE whose words end in a suffix and that drops white space."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec["added_tokens"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or not model.get("end_of_word_suffix") or odd or any(
                t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path} is not a plain BPE with word ends")
        self.tokenizer = load_tokenizer(path)
        if [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str("a \n b")] != ["a", "b"]:
            raise ValueError(f"{path} keeps white space")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.trie = PrefixTrie(model["vocab"], merges, model["end_of_word_suffix"])
        symbols = byte_symbols()
        if not all(s in model["vocab"] and s + model["end_of_word_suffix"] in model["vocab"] for s in symbols.values()):
            raise ValueError(f"{path} lacks some bytes")
        self.symbols = {i: s for i, s in symbols.items()}
        self.added = {t["content"]: t["id"] for t in added}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        self.plain = self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str("AÉ") == "aé"
        self.known = Remembered(160 << 20)

    def words(self, chunk: str) -> list[str | int]:
        """The words of a chunk in byte symbols; a special string is its id."""
        if self.plain and _PLAIN.fullmatch(chunk) and "<" not in chunk:
            words = _WORDS.findall(chunk.lower())
            return words if chunk.isascii() else [self._symbols(w) for w in words]
        parts = self.split.split(chunk) if self.split else [chunk]
        out: list[str | int] = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(self.added[part])
            elif part:
                normal = self.tokenizer.normalizer.normalize_str(part) if self.tokenizer.normalizer else part
                out += [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]
        return out

    def _symbols(self, word: str) -> str:
        return "".join(map(self.symbols.__getitem__, word.encode()))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian unsigned 32-bit."""
        known = self.known
        known.trim()
        split = [t.replace("\n", " ").split(" ") for t in texts]
        new = {c: self.words(c) for c in set(chain.from_iterable(split)) - known.keys()}
        words = {w for ws in new.values() for w in ws if isinstance(w, str)}
        found = {w: pack(f"<{len(ids)}I", *ids) for w, ids in self.trie.encode(words)}
        for c, ws in new.items():
            known.learn(c, b"".join([found[w] if isinstance(w, str) else pack("<I", w) for w in ws]))
        return [b"".join(map(known.__getitem__, s)) for s in split]


@lru_cache(maxsize=2)
def trie_encoder(path: str) -> TrieEncoder:
    return TrieEncoder(path)


def encode(
    df: DataFrame, path: str, text: str = "text", out: str = "ids", keep_text: bool = True, decoded: str | None = None
) -> DataFrame:
    """``df`` with the ids of each whole text under the tokenizer at ``path``, little-endian unsigned
    32-bit in one binary, as the tokenizers library gives them without added special tokens;
    special strings inside a text are read as its default has it.

    The words of a group of texts that a worker does not remember are put into a prefix trie and
    encoded depth first. Nothing is shuffled: a corpus-wide trie would send every occurrence of
    every word through a join. A worker holds a group of texts and about 160 MB of short words.

    A NULL or empty text has no ids. A text or word of any length is encoded whole. Repeated rows
    are encoded each. An empty table gives an empty table. A column named ``out`` is replaced;
    without ``keep_text`` the texts are not handed back; other columns are carried along. With
    ``decoded`` a column of that name has the text of the ids, as ``decode`` gives it, from the same
    worker: two of them for each task would both come to hold the remembered words.
    """
    new = [out, *([decoded] if decoded else [])]
    rest = df.drop(*new) if keep_text else df.drop(*new, text)
    (whole,) = fresh(df, "whole_text")
    schema = T.StructType([
        *rest.schema.fields, T.StructField(out, T.BinaryType()), *[T.StructField(c, T.StringType()) for c in new[1:]]])

    def make():
        encoder, read = trie_encoder(path), _reader(path) if decoded else None

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = encoder.encode(batch.column(batch.num_columns - 1).to_pylist())
            made = [pa.array(ids, pa.binary()), *([pa.array(list(map(read, ids)), pa.string())] if read else [])]
            return pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], schema.names)

        return step

    return map_batches(df.select(*rest.columns, F.coalesce(F.col(text), F.lit("")).alias(whole)), make, schema, _TOGETHER)


@lru_cache(maxsize=2)
def _reader(path: str) -> Callable[[bytes], str]:
    """From ids to their text."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec.get("decoder") is not None:
        raise ValueError(f"{path} has a decoder of its own")
    strings = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    table = [strings.get(i) for i in range(max(strings) + 1)]

    def text(data: bytes) -> str:
        found = np.frombuffer(data, "<u4")
        found = found[found < len(table)]
        return " ".join([s for s in map(table.__getitem__, found.tolist()) if s is not None])

    return text


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded", keep_ids: bool = True) -> DataFrame:
    """``df`` with the text of each binary of ids (as ``encode`` gives them), as the library decodes
    them with special tokens kept: a vocabulary without a decoder gives its tokens with spaces between.

    NULL or no ids give the empty text; ids that no token has are left out. An empty table gives an
    empty table. A column named ``out`` is replaced; other columns are carried along.
    """
    rest = df.drop(out) if keep_ids else df.drop(out, ids)
    (taken,) = fresh(df, "taken_ids")
    schema = T.StructType([*rest.schema.fields, T.StructField(out, T.StringType())])

    def make():
        text = _reader(path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = pa.array([text(x.as_py() or b"") for x in batch.column(batch.num_columns - 1)], pa.string())
            return pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], schema.names)

        return step

    return map_batches(df.select(*rest.columns, F.col(ids).alias(taken)), make, schema, _TOGETHER)
