"""Ranked search against a plain version and SQL."""

import collections
import math
import os
import random
import re

import numpy as np
import pytest

from check_oracles import compare
from tablewash.llm import oracles, queries, ranked

FOLDER = os.environ.get("TABLEWASH_TESTDATA", "/root/testdata/sf0.001")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    own = [(i, collections.Counter(plain_terms(t))) for i, t in docs]
    own = [(i, c, sum(c.values())) for i, c in own if c]
    n_docs, n_terms = len(own), sum(n for _, _, n in own)
    df = collections.Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        wanted, scored = plain_terms(text), []
        for i, c, n in own:
            m = 25 + 75 * n * n_docs // n_terms
            scored.append((-sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                                for t in wanted if t in c), i))
        scored.sort(key=lambda x: (x[0], x[1] is not None, x[1] or 0))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1) if s]
    return sorted(out, key=repr)


def test_terms():
    text = "Déjà-VU x_Y 12.5 É\x00z ÀB　c"
    assert [t.decode() for t in ranked.terms_of(text.encode())] == plain_terms(text)


@pytest.mark.parametrize("part_bytes", [100, 1 << 20])
def test_rank_documents(spark, monkeypatch, part_bytes):
    r = random.Random(part_bytes)
    words = [f"w{int(r.paretovariate(0.6))}" for _ in range(3000)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    docs = [(i, text(r.choice((1, 5, 60, 700)))) for i in range(400)] + [(400, None), (401, ""), (402, " .,"), (403, "same one"), (404, "same one"), (404, "same one"), (None, "same one")]
    items = [(i, text(r.choice((3, 30, 90)))) for i in range(12)] + [(12, None), (13, "..."), (14, "same same one"), (14, "same same one"), (15, "nowhere"), (None, "w1 W1")]
    table = spark.createDataFrame([(*d, "x", 5) for d in docs], "doc_id long, text string, score string, rank int").repartition(3)
    given = spark.createDataFrame([(*d, "x") for d in items], "item_id int, text string, doc_id string")
    out = ranked.rank_documents(table, given, part_bytes=part_bytes)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, out.collect()), key=repr) == plain(docs, items)
    assert ranked.rank_documents(table.limit(0), given).collect() == []
    assert ranked.rank_documents(table, given.limit(0)).collect() == []


def test_masks_are_scored_until_safely_finished(monkeypatch):
    r = np.random.default_rng(1)
    n, terms = 2000, 70
    held = r.random((n, terms)) < r.random(terms) ** 3
    held[0] = True
    doc, term = np.nonzero(held)
    gains = r.integers(1, 50, len(doc)) * (term + 1)
    index = ranked.BlockIndex(np.cumsum(held.sum(axis=1)), term, gains)
    dense = np.zeros((n, terms), np.int64)
    dense[doc, term] = gains
    scored = []
    real = index._scores
    monkeypatch.setattr(index, "_scores", lambda rows, times, docs: (scored.append(len(docs)), real(rows, times, docs))[1])
    ids = r.permutation(n)
    for rows in (np.arange(5, 12), np.arange(terms)):
        times = r.integers(1, 3, len(rows))
        masks, docs, first = index.groups(rows)
        assert sorted(docs) == np.flatnonzero(held[:, rows].any(axis=1)).tolist()
        for mask, d in zip(np.repeat(masks, np.diff(first, append=len(docs)), axis=1).T, docs):
            assert (held[d, rows] == mask.astype(bool)).all()
        want = sorted(((-int(s), int(i)) for s, i in zip(dense[:, rows] @ times, ids) if s))[:10]
        scored.clear()
        scores, found = index.best(rows, times, 10, ids, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
        assert [(-int(s), int(i)) for s, i in zip(scores, found)] == want
        if len(rows) < 10:
            assert sum(scored) < len(docs) / 2


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_query(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = queries.op13_ranked(spark, FOLDER)
    result = con.sql(oracles.RANKED)
    rows = list(map(tuple, df.collect()))
    assert compare(rows, df.columns, result.fetchall(), result.columns) == ""
    given = con.sql("SELECT doc_id, text FROM documents").fetchall(), con.sql("SELECT item_id, text FROM benchmark").fetchall()
    assert sorted(rows, key=repr) == plain(*given)
