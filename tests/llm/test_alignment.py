"""Alignment of two tokenizers against a plain version."""

import collections
import hashlib
import os
import random
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewash.llm import alignment, queries
from tests.llm.test_tokens import BYTES, NASTY, public_tokenizers

PIECES = public_tokenizers.path("piece_bpe_32k.model")
FOLDER = os.environ.get("TABLEWASH_TESTDATA", "/root/testdata/sf0.001")


@lru_cache
def aligner():
    return alignment.Aligner(BYTES, PIECES)


def plain(text):
    """Groups of ids of one whole text, or None."""
    al = aligner()
    if not text:
        return None
    a, b = al.a.encode(" " + text, add_special_tokens=False).ids, al.b.encode(text)
    raw = (" " + text).encode()
    if b"".join(al.bytes_a[i] for i in a) != raw or b"".join(al.bytes_b[i] for i in b) != raw:
        return None
    ends = lambda ids, table: list(np.cumsum([len(table[i]) for i in ids]))
    ends_a, ends_b = ends(a, al.bytes_a), ends(b, al.bytes_b)
    groups, low = [], 0
    for end in sorted(set(ends_a) & set(ends_b)):
        groups.append(([i for i, e in zip(a, ends_a) if low < e <= end], [i for i, e in zip(b, ends_b) if low < e <= end]))
        low = end
    return groups


def expected(texts):
    """The contract's columns of each text, by counting in plain Python."""
    all_groups = [plain(t) for t in texts]
    links = [collections.Counter((x, y) for a, b in g or [] for x in a for y in b) for g in all_groups]
    count = collections.Counter(p for own in links for p in own)
    best = collections.defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for g, own in zip(all_groups, links):
        told = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g or [])
        out.append((
            sum(len(a) for a, _ in g or []), sum(len(b) for _, b in g or []), len(g or []), sum(own.values()),
            sum(n for p, n in own.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in own.items()),
            hashlib.sha256(told.encode()).hexdigest() if g else ""))
    return out, links


@given(st.lists(st.one_of(st.sampled_from([*NASTY, "▁", "<s>", "<0x41>", "\x00"]), st.text(max_size=6)), max_size=30), st.sampled_from(["", " ", "  ", "\n"]))
@settings(max_examples=120, deadline=None)
def test_pieces_give_the_groups_of_the_whole_text(parts, between):
    text = between.join(parts)
    block = alignment.Block(aligner())
    block.add([text])
    measures, postings = block.finish()
    (want,), (links,) = expected([text])
    assert tuple(measures[0]) == want[:4] and block.digests[0] == want[6]
    width = len(aligner().bytes_b)
    got = {}
    for pairs, bitmaps, planes in postings:
        for code, bits, own in zip(pairs, bitmaps, planes):
            assert alignment.unpack(bits).tolist() == [0]
            got[code // width, code % width] = 1 + sum(len(alignment.unpack(p)) << k for k, p in enumerate(own))
    assert got == links


def test_links_counted_before_they_are_written_out(monkeypatch):
    text = "= " + "=-" * 50 + " 漢字" * 3 + " naïve" * 4 + "x" * 99
    (want,), _ = expected([text])
    monkeypatch.setattr(alignment, "EXPANDED", 0)
    block = alignment.Block(alignment.Aligner(BYTES, PIECES))
    block.add([text])
    assert tuple(block.finish()[0][0]) == want[:4]


@given(st.sets(st.integers(0, alignment.BLOCK - 1)))
def test_bitmaps(slots):
    bits = alignment.pack(np.array(sorted(slots), np.int64))
    assert alignment.unpack(bits).tolist() == sorted(slots) and len(bits) <= alignment.BLOCK // 8


def test_popcount_in_spark(spark):
    rows = [(n, alignment.pack(np.arange(n))) for n in (0, 1, 255, 256, 257, alignment.BLOCK)]
    assert all(x.n == x.c for x in spark.createDataFrame(rows, "n long, b binary").select("n", alignment.popcount(F.col("b")).alias("c")).collect())


def test_align(spark, monkeypatch):
    r = random.Random(3)
    words = "the of naïve tokenization 12.5 don't unbelievable ===== 漢字 été re-run\n <|endoftext|>".split(" ")
    texts = [None, "", "one ▁ odd", "same text", "same text", " "] + [" ".join(r.choice(words) for _ in range(r.choice((1, 8, 200)))) for _ in range(120)]
    df = spark.createDataFrame([(i, t, "x", 1.0, None) for i, t in enumerate(texts)], "doc_id long, text string, row string, n_a double, block int")
    out = alignment.align(df.repartition(3), BYTES, PIECES)
    assert out.columns == ["doc_id", "text", "row", "block", *alignment.MEASURES, "groups_sha256", "n_best", "count_sum"]
    want, links = expected(texts)
    for x in out.collect():
        assert (x.n_a, x.n_b, x.n_groups, x.n_links, x.n_best, x.count_sum, x.groups_sha256) == want[x.doc_id] and x.text == texts[x.doc_id]
    got = {(x.a, x.b): (x["count"], x.links) for x in alignment.pair_counts(df, BYTES, PIECES).collect()}
    docs, total = collections.Counter(p for own in links for p in own), sum(links, collections.Counter())
    assert got == {p: (docs[p], total[p]) for p in docs}
    assert alignment.align(df.limit(0), BYTES, PIECES).collect() == []


def test_blocks_end_early(monkeypatch):
    block = alignment.Block(aligner())
    block.add(["word " * 2000] * 900)
    assert block.full()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([d.doc_id for d in docs], expected([d.text for d in docs])[0]))
    rows = queries.op12_alignment(spark, FOLDER).collect()
    assert len(rows) == len(docs)
    assert all((x.n_a, x.n_b, x.n_groups, x.n_links, x.n_best, x.count_sum, x.groups_sha256) == want[x.doc_id] for x in rows)
