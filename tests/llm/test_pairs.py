"""Archives, near duplicates, decontamination, and the pipeline."""

import collections
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tablewash.llm import components, decontaminate, near_dups, queries, warc
from tablewash.llm.common import shingle_hashes, text_parts, word_hashes

FOLDER = os.environ.get("TABLEWASH_TESTDATA", "/root/testdata/sf0.001")


# Archives

PAGES = "page_id long, url string, html string, first string"


def archive(spark, rows, split, **kw):
    files = warc.write_warc(spark.createDataFrame(rows, PAGES).repartition(2), **kw)
    return {r.record_id.removeprefix(warc.NAME): r for r in warc.read_warc(spark, files, split).collect()}, files


@pytest.mark.parametrize("compress", [True, False])
def test_archive_round_trip(spark, compress):
    inner = warc.record("99", "u", b"inner", 5, warc.digest(b"inner"), None).decode()
    rows = [(1, "http://a b", "x" * 6000, None), (2, None, inner, None), (3, "u", None, None), (4, "u", "", None),
            (7, "u", "x" * 6000, None), (5, "u", "é" + inner * 3 + "WARC/1.0\r\n", None), (6, "u", inner, None)]
    got, files = archive(spark, rows, 700, compress=compress, file_bytes=5000)
    assert files.count() > 1 or compress
    assert set(got) == {str(r[0]) for r in rows}
    firsts = {}
    for page, _, html, _ in sorted(rows, key=lambda r: r[0]):
        data = (html or "").encode()
        first = firsts.setdefault(data, page)
        r = got[str(page)]
        assert r.payload_bytes == len(data) and r.payload_digest == warc.digest(data)
        if first == page:
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("response", None, data)
        else:
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", f"{warc.NAME}{first}", None)
    assert got["1"].url == "http://a%20b"


def test_archive_edges(spark):
    got, _ = archive(spark, [(1, "u", "aa", None), (2, "u", "aa", None), (None, "u", "long enough", None), (3, "u", "long enough", None)], 100, revisit_from=5)
    assert {k: r.record_type for k, r in got.items()} == {"1": "response", "2": "response", "3": "response", "": "revisit"}
    assert archive(spark, [], 100)[0] == {}


def test_splits_are_read_by_many_tasks(spark):
    rows = [(i, "u", f"{i}" * 3000, None) for i in range(60)]
    files = warc.write_warc(spark.createDataFrame(rows, PAGES).repartition(2), compress=False)
    read = warc.read_warc(spark, files, 10_000).withColumn("task", F.spark_partition_id())
    assert read.count() == 60 and read.select("task").distinct().count() > 5


def test_broken_archive_raises(spark):
    _, files = archive(spark, [(i, "u", f"{i}" * 3000, None) for i in range(6)], 500, compress=False)
    path = files.first().path.removeprefix("file://").removeprefix("file:")
    with open(path, "r+b") as f:
        f.truncate(os.path.getsize(path) - 10)
    sizes = spark.createDataFrame([(path, os.path.getsize(path))], "path string, bytes long")
    with pytest.raises(ValueError, match="whole chain"):
        warc.read_warc(spark, sizes, 500)


# Near duplicates

def test_depths_reach_the_recall():
    for trees, label, recall in [(40, 10, 0.9995), (30, 12, 0.99), (60, 12, 0.9999)]:
        depths = near_dups.depths_by_rank(0.8, trees, label, recall)
        miss = lambda d: np.prod([1 - 0.8**x for x in d])
        assert depths == sorted(depths, reverse=True) and depths[0] > depths[-1] and 1 - miss(depths) >= recall
        last = [k for k, d in enumerate(depths) if d < label][0]
        assert 1 - miss([d + (k == last) for k, d in enumerate(depths)]) < recall


def test_forest_nodes_equal_brute_force(spark, monkeypatch):
    """Every text meets all texts with which it shares the prefix it asks for, in nodes of any size."""
    monkeypatch.setattr(near_dups, "BLOCK", 3)
    r = np.random.default_rng(3)
    trees, label, least, depths = 6, 4, 2, [4, 4, 3, 2, 2, 2]
    values = r.integers(0, 3, (60, trees, label)).astype(np.uint16)
    values[:25, :, :2] = 7
    texts = spark.createDataFrame([(t, v.tobytes()) for t, v in enumerate(values)], "tid long, labels binary").repartition(5)
    shared = near_dups.matched_prefixes(texts, trees, label, least)
    seen = {(x.tid, x.tree) for x in shared.collect()}
    prefix = lambda x, t, d: tuple(values[x, t, :d])
    size = collections.Counter((t, prefix(x, t, least)) for x in range(60) for t in range(trees))
    assert seen >= {(x, t) for x in range(60) for t in range(trees) if size[t, prefix(x, t, least)] > 1}
    placed = collections.defaultdict(set)
    for x in near_dups.chosen_nodes(shared, least, depths, label).collect():
        placed[x.of].add(x.tid)
    met = {(x, y) for node in placed.values() for x in node for y in node}
    for x in range(60):
        large = sorted((t for t in range(trees) if size[t, prefix(x, t, least)] > 3),
                       key=lambda t: (size[t, prefix(x, t, least)], t), reverse=True)
        asks = {t: depths[large.index(t)] if t in large else least for t in range(trees)}
        for t in range(trees):
            assert all((x, y) in met for y in range(60) if y != x and prefix(x, t, asks[t]) == prefix(y, t, asks[t]))
    assert any(0 < len(n) for n in placed.values()) and max(map(len, placed.values())) < max(size.values()) + 1


def test_large_nodes_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK", 4)
    r = random.Random(4)
    base, rows = [f"w{r.randint(0, 5000)}" for _ in range(150)], []
    for n in range(90):
        w = list(base) if n < 60 else [f"x{r.randint(0, 5000)}" for _ in range(60)]
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = f"v{r.randint(0, 99)}"
        rows += [(n, " ".join(w))] * (1 if n % 3 else 20)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    texts, links, root = brute_classes(rows)
    got = {x.text_key: (x.n_links, x.n_copies) for x in near_dups.near_duplicates(df).collect()}
    copies = collections.Counter(t for _, t in rows)
    assert sorted(got.values()) == sorted((links[i], copies[t]) for i, t in enumerate(texts))


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + r.randint(0, 40), 100 + r.randint(0, 40)) for _ in range(30)] + [(7, 7), (None, 3)]
    root = {}
    def find(x):
        root.setdefault(x, x)
        return x if root[x] == x else find(root[x])
    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    out = components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {x.node: x.root for x in out} == {n: find(n) for n in root} and len(out) == len(root)
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def shingles(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(rows):
    texts = sorted({t for _, t in rows if shingles(t)})
    sets, links, root = [shingles(t) for t in texts], collections.Counter(), list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common >= 0.8 * (len(sets[i]) + len(sets[j]) - common):
                links[i] += 1
                links[j] += 1
                a, b = root[i], root[j]
                root = [a if x == b else x for x in root]
    return texts, links, root


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(2)
    base = [[f"w{r.randint(0, 5000)}" for _ in range(120)] for _ in range(12)]
    rows, n = [], 0
    for k, words in enumerate(base):
        for _ in range(30 if k == 0 else 4):
            w = list(words)
            for _ in range(r.randint(0, 6)):
                w[r.randrange(len(w))] = "new"
            rows.append((n, " ".join(w)))
            n += 1
    rows += [(n, rows[0][1]), (n + 1, rows[0][1]), (None, rows[5][1]), (n + 2, "a b c"), (n + 3, "a b c"), (n + 4, ""), (n + 5, None), (n + 6, " \n"),
             (n + 6, rows[9][1]), (n + 6, rows[9][1])]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, key string").repartition(4)
    got = near_dups.near_duplicates(df).collect()
    assert len(got) == len(rows)
    texts, links, root = brute_classes(rows)
    ids = collections.defaultdict(list)
    for d, t in rows:
        ids[t].append(d)
    wanted = []
    for d, t in rows:
        if not shingles(t):
            wanted.append((d, d, 0, 1))
            continue
        i = texts.index(t)
        smallest = min(x for j, u in enumerate(texts) if root[j] == root[i] for x in ids[u] if x is not None)
        wanted.append((d, smallest, links[i], len(ids[t])))
    order = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((x.doc_id, x.class_id, x.n_links, x.n_copies) for x in got), key=order) == sorted(wanted, key=order)
    kept = near_dups.one_of_each(df).collect()
    assert len(kept) == len(set(root)) + 3 and all(x["key"] == "x" for x in kept)
    assert near_dups.near_duplicates(df.limit(0)).collect() == []


def test_prefixes_shorten_until_the_recall():
    assert near_dups.prefix_depth(0.8, 40, 10, 0.9995) == 7
    assert near_dups.prefix_depth(0.8, 40, 10, 0.999999) < 7
    with pytest.raises(ValueError):
        near_dups.prefix_depth(0.1, 2, 5, 0.99)


def test_similar_blocks_equal_sets():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 60, r.integers(1, 50))).astype(np.uint64) for _ in range(40)] + [np.zeros(0, np.uint64)]
    got = near_dups.similar(sets, 0.5)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            a_, b_ = set(a.tolist()), set(b.tolist())
            assert got[i, j] == (i != j and bool(a_) and bool(b_) and len(a_ & b_) >= 0.5 * len(a_ | b_))


def test_word_hashes_follow_words():
    import pyarrow as pa

    texts = ["a b", "", "b  a\n", "é a", "\x0bab", "b"]
    words = []
    for _, data, offsets in text_parts(pa.array(texts)):
        h, s = word_hashes(data, offsets)
        words += [h[a:b].tolist() for a, b in zip(s, s[1:])]
    a, b = words[0]
    assert [len(w) for w in words] == [2, 0, 2, 2, 1, 1] and words[2] == [b, a] and words[3][1] == a and words[5] == [b]
    assert len(shingle_hashes(np.arange(3, dtype=np.uint64), 5)) == 1


# Decontamination

def test_passages_are_found_and_others_left(spark):
    r = random.Random(4)
    word = lambda: f"w{r.randint(0, 3000)}"
    items = [[word() for _ in range(n)] for n in (3, 9, 15, 16, 22, 30, 37, 48, 59, 70)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(50, None), (51, "")], "item_id long, text string")
    rows, wanted = [], set()
    for d in range(150):
        w = [word() for _ in range(r.choice((0, 5, 60, 400)))]
        if d % 3 == 0:
            i = r.randrange(len(items))
            passage = list(items[i])
            if len(passage) > 40:
                passage[1] = "changed"
            at = r.randint(0, len(w))
            w[at:at] = [p.upper() for p in passage] if d % 2 else passage
            wanted.add((d, i))
        rows.append((d, " ".join(w), "k"))
    rows += [(900, None, "k"), (901, "", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, whole_text string").repartition(3)
    out = decontaminate.find_passages(df, bench)
    assert out.columns == ["doc_id", "whole_text", "item_id", "similarity", "first_word"]
    got = {(x.doc_id, x.item_id): x for x in out.collect()}
    assert set(got) == wanted
    texts = {d: t for d, t, _ in rows}
    for (d, i), x in got.items():
        assert x.similarity >= 0.8
        if len(items[i]) <= 40:
            assert [w.lower() for w in texts[d].split()[x.first_word :][: len(items[i])]] == items[i]
    clean = decontaminate.without_passages(df, bench)
    assert clean.columns == df.columns and {x.doc_id for x in clean.collect()} == set(texts) - {d for d, _ in wanted}
    assert decontaminate.find_passages(df, bench.limit(0)).collect() == []
    assert decontaminate.find_passages(df.limit(0), bench).collect() == []


def edited_passages(seed, copies):
    """Items, texts with an edited copy of one of them each, and what brute force over all windows finds."""
    r = random.Random(seed)
    word = lambda: f"w{r.randint(0, 3000)}"
    phrase = [word() for _ in range(7)]
    items = [[word() for _ in range(n)] for n in (15, 24, 27, 34, 38, 51, 52, 59)]
    items += [[*phrase, *(word() for _ in range(n))] for n in (20, 33)] + [["again", "and"] * 15]
    texts = []
    for k in range(copies):
        passage, filler = list(items[k % len(items)]), [[word() for _ in range(r.choice((0, 3, 90)))] for _ in range(2)]
        for _ in range(r.choice((0, 1, 1, 2))):
            at = r.randrange(len(passage))
            passage[at : at + r.choice((0, 1, 1))] = r.choice(([], [word()]))
        if k % 4 == 0:
            passage = passage[r.randint(0, 3) : len(passage) - r.randint(0, 3)]
        texts.append([*filler[0], *passage, *filler[1]])
    index = decontaminate.Index(list(range(len(items))), [" ".join(w) for w in items])
    offsets = np.cumsum([0, *map(len, texts)])
    hashes = [word_hashes(np.frombuffer(" ".join(w).encode(), np.uint8), np.array([0, len(" ".join(w))]))[0] for w in texts]
    wanted = {}
    for t, h in enumerate(hashes):
        for i, w in enumerate(items):
            best = max(index.similarity(i, shingle_hashes(h[q : q + len(w)], 5)) for q in range(max(1, len(h) - len(w) + 1)))
            if best >= 0.8:
                wanted[t, i] = best
    return index, np.concatenate(hashes), offsets, wanted


def test_no_passage_at_the_threshold_is_lost():
    index, hashes, offsets, wanted = edited_passages(3, 500)
    got = {(t, i): s for t, i, s, _ in decontaminate.search(index, hashes, offsets, 0.8)}
    assert sum(s < 0.85 for s in wanted.values()) > 20
    assert got == pytest.approx(wanted)


def test_passages_at_the_threshold_across_parts(monkeypatch):
    monkeypatch.setattr(decontaminate, "HELD_WORDS", 300)
    index, hashes, offsets, wanted = edited_passages(8, 120)
    assert {(t, i): s for t, i, s, _ in decontaminate.search(index, hashes, offsets, 0.8)} == pytest.approx(wanted)


def test_results_do_not_depend_on_the_parts(spark, monkeypatch):
    r = random.Random(9)
    word = lambda: f"w{r.randint(0, 3000)}"
    phrase, items, docs = [word() for _ in range(12)], [], []
    for i in range(24):
        items.append([*phrase, *(word() for _ in range(18))])
        passage = list(items[i])
        passage[3] = "edited"
        docs.append((i, " ".join([*(word() for _ in range(20)), *passage, *(word() for _ in range(20))])))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(24, " ".join(items[0]))], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    results = []
    for at_once, size in ((2048, 1 << 20), (13, 1 << 20), (2, 1 << 20), (2048, 100)):
        monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", at_once)
        monkeypatch.setattr(decontaminate, "BYTES_AT_ONCE", size)
        found = decontaminate.find_passages(df, bench).collect()
        results.append(sorted((x.doc_id, x.item_id, round(x.similarity, 9), x.first_word) for x in found))
        assert decontaminate.without_passages(df, bench).count() == 0
    assert len(results[0]) == 25 and all(x == results[0] for x in results)
    index = decontaminate.Index(list(range(25)), [" ".join(w) for w in [*items, items[0]]])
    texts = [np.frombuffer(t.encode(), np.uint8) for _, t in docs]
    for d, t in enumerate(texts):
        h = word_hashes(t, np.array([0, len(t)]))[0]
        best = max(index.similarity(d, shingle_hashes(h[q : q + 30], 5)) for q in range(len(h) - 29))
        assert [x[2] for x in results[0] if x[:2] == (d, d)] == [pytest.approx(best)]


def test_multi_index_is_whole():
    r = np.random.default_rng(5)
    index = decontaminate.Index(list(range(30)), [" ".join(f"w{x}" for x in r.integers(0, 500, 20)) for _ in range(30)])
    (only,) = index.classes
    prints = index.prints[only.items][r.integers(0, 30, 4000)]
    for _ in range(14):
        prints = prints ^ (np.uint64(1) << r.integers(0, 64, 4000).astype(np.uint64))
    windows, items = index.candidates(only, prints)
    distance = np.bitwise_count(prints[:, None] ^ only.prints[None, :])
    assert set(zip(windows.tolist(), items.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(distance <= index.radius))))


# Pipeline and queries

def test_pipeline_on_a_fixture(spark, tmp_path):
    r = random.Random(7)
    words = lambda n: [f"t{r.randint(0, 4000)}ab" for _ in range(n)]
    item = words(30)
    texts = [" ".join(words(60)) for _ in range(30)]
    near = texts[1].split()
    near[30] = "other"
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100, texts[0]), (101, " ".join(near)), (102, "too short"), (103, " ".join(words(20) + item + words(20))),
             (104, " ".join(words(40)) + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end'), (105, None)]
    spark.createDataFrame(
        [(d, t, "en", "s", None, "x", "y", "z") for d, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long, kept string, findings string, key string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == 4 or docs.columns == columns
        assert docs.where("kept = 'x' AND findings = 'y' AND key = 'z'").count() == docs.count()
        seen.append({x.doc_id for x in docs.select("doc_id").collect()})
    everything = {*range(30), 100, 101, 103, 104}
    assert seen == [everything, everything - {100, 101}, everything - {100, 101, 103}, *[everything - {100, 101, 103}] * 2]
    redacted = spark.read.parquet(f"{tmp_path}/3").where("doc_id = 104").first()
    assert redacted.text.endswith('token = "[SECRET]" end') and redacted.n_chars == len(redacted.text)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", [n for n in sorted(queries.QUERIES) if n.split("_")[0] not in ("op11", "op12", "op13")])
def test_query(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    assert len(set(df.columns)) == len(df.columns) and df.count() > 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_queries_equal_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from check_oracles import compare

    for t in ("documents", "conversations", "benchmark"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, FOLDER)
        result = duckdb.sql(sql)
        assert compare([tuple(r) for r in df.collect()], df.columns, result.fetchall(), result.columns) == ""
