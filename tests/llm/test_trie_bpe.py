"""Ids and decoded texts against the library."""

import hashlib
import itertools
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablewash.llm import queries, tokens, trie_bpe
from tests.llm.test_tokens import NASTY, WORDS, library

FOLDER = os.environ.get("TABLEWASH_TESTDATA", "/root/testdata/sf0.001")


def ids_of(text):
    return np.frombuffer(trie_bpe.trie_encoder(WORDS).encode([text])[0], "<u4").tolist()


@given(st.lists(st.one_of(st.sampled_from(NASTY), st.text(max_size=6), st.text("abcdeéinot'", max_size=12)), max_size=30),
       st.sampled_from(["", " ", "  ", "\n"]))
@settings(max_examples=300, deadline=None)
def test_ids_are_the_librarys(parts, between):
    text = between.join(parts)
    assert ids_of(text) == library(WORDS, text)


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, "漢字" * 2000, "!" * 999, "the" * 700 + "ing", "İstanbul ΟΔΟΣ", "x<|endoftext|>y" * 50])
def test_long_and_odd_words(text):
    assert ids_of(text) == library(WORDS, text)


def test_every_token_and_shared_prefixes():
    encoder = trie_bpe.TrieEncoder(WORDS)
    vocabulary = encoder.tokenizer.get_vocab()
    words = [t.removesuffix("</w>") for t in itertools.islice(vocabulary, 0, None, 7) if t.endswith("</w>") and len(t) > 5 and t[:-4].isalpha() and t.isascii()]
    words += [w + x for w in words[:500] for x in ("s", "ing", "xq")]
    want = {w: library(WORDS, w) for w in words}
    assert dict(encoder.trie.encode(set(words))) == want


def test_prefix_states_are_worked_out_once(monkeypatch):
    trie = trie_bpe.TrieEncoder(WORDS).trie
    seen = []
    last = trie._last
    monkeypatch.setattr(trie, "_last", lambda word, d, suffix, states: (seen.append((word[:d], suffix)), last(word, d, suffix, states))[1])
    list(trie.encode({"stare", "start", "starting", "starts", "stone"}))
    assert len(seen) == len(set(seen))


def test_a_vocabulary_out_of_order_is_refused():
    ids = {s: i for i, s in enumerate(["a", "b", "c", "a~", "b~", "c~", "ab", "abc", "ab~"])}
    with pytest.raises(ValueError):
        trie_bpe.PrefixTrie(ids, [("ab", "c"), ("a", "b")], "~")
    assert dict(trie_bpe.PrefixTrie(ids, [("a", "b"), ("ab", "c"), ("a", "b~")], "~").encode(["abc", "cab"])) == {"abc": [6, 5], "cab": [2, 8]}


def test_encode_and_decode(spark):
    texts = [None, "", "two Words", "two Words", "lorem ipsum " * 9000, "<|endoftext|> é"]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, whole_text string, ids string")
    out = trie_bpe.encode(df, WORDS)
    assert out.columns == ["doc_id", "text", "whole_text", "ids"]
    back = trie_bpe.decode(out, WORDS, out="text")
    assert back.columns == ["doc_id", "whole_text", "ids", "text"]
    decoder = tokens.load_tokenizer(WORDS)
    at_once = trie_bpe.encode(df, WORDS, decoded="row")
    assert at_once.columns == [*out.columns, "row"]
    assert {(x.doc_id, x.row) for x in at_once.collect()} == {(x.doc_id, x.text) for x in back.collect()}
    for x in back.collect():
        ids = library(WORDS, texts[x.doc_id] or "")
        assert np.frombuffer(bytes(x.ids), "<u4").tolist() == ids and x.text == decoder.decode(ids, skip_special_tokens=False)
    assert trie_bpe.decode(trie_bpe.encode(df.limit(0), WORDS, keep_text=False), WORDS).collect() == []
    odd = spark.createDataFrame([(None,), (np.array([320, 49408, 4000000000], "<u4").tobytes(),)], "ids binary")
    assert {x.decoded for x in trie_bpe.decode(odd, WORDS).collect()} == {"", decoder.decode([320], skip_special_tokens=False)}


def test_memory_of_words_is_bounded():
    known = trie_bpe.Remembered(limit=20_000, longest=8)
    for i in range(1000):
        known.learn(f"w{i}", b"1234")
        known.learn(f"long word {i}", b"1234")
        known.trim()
    assert known.held <= 20_000 and len(known) < 100 and all(len(w) <= 8 for w in known)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_query(spark):
    decoder = tokens.load_tokenizer(WORDS)
    texts = dict(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect())
    rows = queries.op11_bpe(spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for x in rows:
        ids = library(WORDS, texts[x.doc_id] or "")
        assert (x.n_tokens, x.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert x.decoded_sha256 == hashlib.sha256(decoder.decode(ids, skip_special_tokens=False).encode()).hexdigest()
