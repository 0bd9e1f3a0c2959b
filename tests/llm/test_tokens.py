"""Token counts, packing and page extraction."""

import itertools
import json
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewash.llm import extract, packing, tokens
from tablewash.llm.labelled_pages import labelled_pages

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
NASTY = ["a  b", " \n x", "<|endoftext|>", "it's", "é", "क़,", "İ,", "Σ", "́", "12.5", "\t", "　", "\x1c", "\x85", "ß|", "word", "***", "\n\n", "don't.",
         "<|ENDOFTEXT|>", "<|EndOfText|>", "<|StartOfText|>", "Ab<|ENDOFTEXT|>Cd", "Ab<|endoftext|>Cd."]


def library(path, text):
    return tokens.load_tokenizer(path).encode(text, add_special_tokens=False).ids


@given(st.lists(st.one_of(st.sampled_from(NASTY), st.text(max_size=6)), max_size=30), st.sampled_from(["", " ", "  ", "\n"]))
@settings(max_examples=150, deadline=None)
def test_counts_and_ids_are_the_librarys(parts, between):
    text = between.join(parts)
    cache = tokens.WordCache(BYTES, len)
    assert sum(cache[p] for p in tokens.safe_parts(text) if text) == len(library(BYTES, text))
    encode, _ = packing._encoder(WORDS, 1)
    assert list(next(encode([text]))) == [*library(WORDS, text), 1]
    if text:
        assert tokens.count_tokens_spliced(tokens.load_tokenizer(BYTES), text, 40, 4) == len(library(BYTES, text))


@pytest.mark.parametrize("text", [
    "<|ENDOFTEXT|>", "<|EndOfText|>", "<|endoftext|>", "<|STARTOFTEXT|>", "Ab<|ENDOFTEXT|>Cd", "Ab<|endoftext|>Cd. <|EndOfText|>!", "WORD Word."])
def test_special_strings_keep_their_letter_case(text):
    encode, _ = packing._encoder(WORDS, 1)
    assert list(next(encode([text]))) == [*library(WORDS, text), 1]


@given(st.lists(st.one_of(st.sampled_from([*NASTY, "'S", "!'ll", "''ve", "Ⱥb", "Əl", "ǅ7", "x\r", "—", "it’s", "Ab,CD12;"]), st.text("aB'éƁ1! \t\n漢", max_size=6)), max_size=30), st.sampled_from(["", " ", "\n"]))
@settings(max_examples=150, deadline=None)
def test_parts_and_whole_words_make_up_a_text(parts, between):
    text = between.join(parts)
    encode, _ = packing._encoder(WORDS, 1)
    assert list(next(encode([text]))) == [*library(WORDS, text), 1]


def test_every_plain_character_is_cut_as_the_library_does():
    encode, _ = packing._encoder(WORDS, 1)
    for i in (*range(1, 0x300), *range(0x2C60, 0x2C80)):
        for text in (f"a{chr(i)}b {chr(i)}1{chr(i)}", f"!{chr(i)}!{chr(i)}{chr(i)}"):
            assert list(next(encode([text]))) == [*library(WORDS, text), 1], text


def test_plain_words_do_not_take_the_whole_library(monkeypatch):
    monkeypatch.setattr(packing, "_ENCODERS", {})
    text = "Plain words, PLAIN WORDS: 12 éa (Éa)! It's\tsome***"
    want = [*library(WORDS, text), 1]
    encode, _ = packing._encoder(WORDS, 1)
    monkeypatch.setattr(packing._ENCODERS[WORDS][0], "tokenizer", None)
    assert list(next(encode([text]))) == want


@pytest.mark.parametrize("change", [
    {"normalizer": None}, {"pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}},
    {"added_tokens": [{"id": 49406, "content": ",", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}]}])
def test_other_tokenizers_keep_their_own_cuts(tmp_path, change):
    path = tmp_path / "other.json"
    with open(WORDS) as f:
        path.write_text(json.dumps(json.load(f) | change))
    text = "Words, WORDS: 12 éa Éa! It's some***\nword漢, x,"
    encode, _ = packing._encoder(str(path), 1)
    assert list(next(encode([text]))) == [*library(str(path), text), 1]


@pytest.mark.parametrize("text", ["ab" * 3000, "word " * 4000, "\n" * 3000, " a  b" * 2000, "x y " + "é" * 5000 + " <|endoftext|> end"])
def test_spliced_counts_of_long_texts(text):
    assert tokens.count_tokens_spliced(tokens.load_tokenizer(BYTES), text, 1000, 16) == len(library(BYTES, text))


def test_count_tokens(spark):
    rows = [(1, None, "x"), (2, "", "x"), (2, "two words", "x"), (2, "two words", "x"), (3, "lorem ipsum " * 9000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, whole_text string")
    out = tokens.count_tokens(df, BYTES)
    assert out.columns == ["doc_id", "text", "whole_text", "n_tokens"]
    assert sorted(x.n_tokens for x in out.collect()) == sorted(len(library(BYTES, t or "")) for _, t, _ in rows)
    assert tokens.count_tokens(df.limit(0), BYTES, keep_text=False).collect() == []


# Packing

def test_cuts_are_the_cheapest():
    r = random.Random(5)
    for _ in range(200):
        places = sorted({0, *(r.randint(1, 40) for _ in range(9))})
        places = [p for p in places] + ([places[-1] + 3] if len(places) < 2 else [])
        length = max(max(np.diff(places)), r.randint(5, 20))
        costs = [r.choice((0, 2, 5)) for _ in places]
        cost, back = packing.choose_cuts(places, costs, length)
        best = min(
            (sum(length - (b - a) for a, b in zip(way, way[1:])) + sum(costs[places.index(p)] for p in way[1:])
             for n in range(len(places) - 1) for mid in itertools.combinations(places[1:-1], n)
             for way in [[0, *mid, places[-1]]] if all(b - a <= length for a, b in zip(way, way[1:]))))
        assert cost[-1] == best
        way = packing.way(back, len(places) - 1)
        assert sum(length - (places[b] - places[a]) + costs[b] for a, b in zip(way, way[1:])) == best


def check_packed(rows, ids, length):
    sequences, pieces = {}, {}
    for x in rows:
        sequences.setdefault(x.sequence_id, []).append((x.offset, x.length))
        pieces.setdefault(x.doc_id, []).append((x.start, x.length, x.ids, x.doc_tokens))
    padding = 0
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert 0 < at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    for doc, own in pieces.items():
        own.sort()
        got = np.frombuffer(b"".join(bytes(p[2]) for p in own), "<u4")
        assert list(got) == ids[doc] and all(p[3] == len(ids[doc]) for p in own)
        assert [p[0] for p in own] == [0, *itertools.accumulate(p[1] for p in own)][:-1]
    assert set(pieces) == set(ids)
    return padding / sum(map(len, ids.values()))


def test_packing(spark):
    r = random.Random(6)
    texts = [None, "", "Hi. There.", "no end " * 2000] + [
        " ".join(r.choice("the of and. ing, tion ver! 12".split()) for _ in range(r.choice((3, 40, 700)))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "k", 0) for i, t in enumerate(texts)], "doc_id long, text string, extra string, length int").repartition(3)
    out = packing.pack(df, WORDS, 256)
    assert out.columns == ["doc_id", "extra", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    ids = {i: [*library(WORDS, t or ""), 1] for i, t in enumerate(texts)}
    rows = out.withColumn("crc", F.crc32("ids")).collect()
    assert check_packed(rows, ids, 256) < 0.03
    assert all(x.crc == zlib.crc32(bytes(x.ids)) for x in rows)
    assert packing.pack(df.limit(0), WORDS).collect() == []
    only = packing.pack(df.select("text"), WORDS).agg(F.sum("length")).first()[0]
    assert only == sum(map(len, ids.values()))


# Page extraction

@pytest.fixture(scope="module")
def model():
    return extract.train(labelled_pages(150), 100)


def test_messages_give_exact_marginals():
    r = np.random.default_rng(2)
    parent = [-1, 0, 0, 1, 1, 2]
    forest = extract.Forest([parent], [[0, 1, 1, 2, 2, 2]], [[False, False, False, True, True, True]])
    own, pairs = r.normal(size=(6, 2)), r.normal(size=(2, 2, 2))
    chance, both, norm = forest.marginals(own, pairs)
    weights = {}
    for y in itertools.product((0, 1), repeat=6):
        weights[y] = np.exp(sum(own[i, y[i]] for i in range(6)) + sum(pairs[int(i > 2), y[parent[i]], y[i]] for i in range(1, 6)))
    total = sum(weights.values())
    assert norm == pytest.approx(np.log(total))
    for i in range(6):
        assert chance[i, 1] == pytest.approx(sum(w for y, w in weights.items() if y[i]) / total)
    assert both[4][1, 0] == pytest.approx(sum(w for y, w in weights.items() if y[1] and not y[4]) / total)


def test_held_out_pages(model):
    pages = labelled_pages(120, seed=11)
    got = extract.main_blocks([h for h, _ in pages], model)
    assert sum(g == b for g, (_, b) in zip(got, pages)) / len(pages) > 0.93


def test_extract_text(spark, model):
    page = ('<html><head><title>T</title><script>var a="<p>x</p>"</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav>'
            '<article><h1>A &amp; B</h1><p>First  line,\n more of&nbsp;it and it goes on.<p><b>Second one, longer than the first.<br></article>'
            '<div id="comments"><p>I like it, said a reader.</p></div><footer>&copy; 2024</footer></body></html>')
    rows = [(1, page, "x"), (2, None, "x"), (3, "", "x"), (4, "<p", "x"), (5, "</div></p><", "x"), (6, "<div>" * 3000, "x"), (1, page, "x")]
    df = spark.createDataFrame(rows, "page_id long, html string, whole_html string")
    out = extract.extract_text(df, model=model)
    assert out.columns == ["page_id", "whole_html", "main_text"]
    got = [(x.page_id, x.main_text) for x in out.collect()]
    assert got.count((1, "A & B\nFirst line, more of it and it goes on.\nSecond one, longer than the first.")) == 2
    assert all(t == "" for p, t in got if p != 1 and p != 4) and len(got) == 7
    assert extract.extract_text(df.limit(0), model=model).collect() == []
