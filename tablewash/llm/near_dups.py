"""Similarity self-join of texts on word shingles: a MinHash LSH forest, then exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewash.llm.common import fresh, map_batches, materialize, shingle_hashes, text_key, text_parts, word_hashes
from tablewash.llm.components import components

WORDS, THRESHOLD = 5, 0.8
#: Tries of the forest, the length of their labels, and the share of pairs at the threshold to be met.
TREES, LABEL, RECALL = 40, 10, 0.9995
#: Label values by which two texts of a node are compared.
SKETCH = 280
#: Words of 64 bits in the bitmap that tells which texts may be in a family: 4 MB as broadcast rows.
BITMAP = 1 << 18
#: Texts in one block of a node or of a family, and shingles in one block of a family.
BLOCK, BLOCK_SHINGLES = 192, 100_000
#: A pair whose signatures agree this much less often than the threshold belongs to another family.
MARGIN = 0.2
_CHUNK = 2048


def prefix_depth(threshold: float = THRESHOLD, trees: int = TREES, label: int = LABEL, recall: float = RECALL) -> int:
    """How far the prefixes of a text have to be shortened if all its trees are treated alike: the
    longest prefix with which a pair at the threshold meets in some tree with probability
    ``recall``: 1 - (1 - s ** d) ** trees."""
    for depth in range(label, 0, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    raise ValueError("too few trees for this recall")


def depths_by_rank(threshold: float = THRESHOLD, trees: int = TREES, label: int = LABEL, recall: float = RECALL) -> list[int]:
    """Prefix lengths for the trees of a text whose nodes are all large, the largest node first.

    Whole labels are shortened value by value, from the smallest node on, until the chance that a
    pair at the threshold is met in no tree, the product of 1 - s ** d, is 1 - ``recall`` at most;
    the largest nodes stay longest. Where only some of a text's nodes are large, these take the
    first ranks and the others the shortest prefix, so the target holds all the more."""
    least = prefix_depth(threshold, trees, label, recall)
    depths = [label] * trees
    for rank in reversed(range(trees)):
        while depths[rank] > least:
            if 1 - math.prod(1 - threshold**d for d in depths) >= recall:
                return depths
            depths[rank] -= 1
    return depths


def _hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_917)
    return rng.integers(0, 2**32, n, np.uint32) | np.uint32(1), rng.integers(0, 2**32, n, np.uint32)


def signature(shingles: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least value of each hash function over the shingles."""
    a, b = family[0][:, None], family[1][:, None]
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(a), 2**32 - 1, np.uint32)
    for at in range(0, len(x), _CHUNK):
        values = a * x[None, at : at + _CHUNK]
        values += b
        np.minimum(least, values.min(axis=1), out=least)
    return least


def sign_texts(df: DataFrame, text: str, trees: int, label: int, words: int) -> DataFrame:
    """``df`` without its text, with ``n_shingles`` and ``labels``: one label for each tree, next to
    one another, of ``label`` values of two bytes each (the low bits of a signature value)."""
    rest = df.drop(text)
    schema = rest.select("*", F.lit(0).cast("long").alias("n_shingles"), F.lit(None).cast("binary").alias("labels")).schema
    (whole,) = fresh(df, "whole_text")

    def make():
        family = _hash_family(trees * label)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, labels = [], []
            for _, data, offsets in text_parts(batch.column(batch.num_columns - 1)):
                hashes, starts = word_hashes(data, offsets)
                for i in range(len(offsets) - 1):
                    shingles = shingle_hashes(hashes[starts[i] : starts[i + 1]], words)
                    counts.append(len(np.unique(shingles)))
                    labels.append(signature(shingles, family).astype(np.uint16).tobytes() if len(shingles) else b"")
            return pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(counts, pa.int64()), pa.array(labels, pa.binary())], schema.names)

        return step

    return map_batches(df.select(*rest.columns, F.coalesce(F.col(text), F.lit("")).alias(whole)), make, schema)


def near_duplicates(
    df: DataFrame, doc: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD,
    trees: int = TREES, label: int = LABEL, recall: float = RECALL,
) -> DataFrame:
    """One row for each row of ``df``: its ``doc`` column, ``text_key``, ``class_id`` (smallest ``doc`` of
    the class), ``class_key`` (smallest ``text_key`` of the class), ``n_links`` (other texts with a Jaccard similarity of ``threshold`` or more) and
    ``n_copies`` (rows with the same text, this one included).

    Texts are sets of ``words``-word shingles, words being parted by ASCII white space and compared as
    they are; a text of fewer words is one shingle. Two texts are linked if their similarity is at
    least ``threshold``; a class is all that copies and links connect.

    1. Equal texts become one text, by 128 bits of hash.
    2. Each text gets a label in every tree of the forest. Labels are sorted, so that neighbours show
       the prefix they match and every node of a trie is a run of them. A text's prefixes are
       shortened until ``recall`` is reached for a pair at the threshold, those of its largest nodes
       last (``depths_by_rank``); texts that share such a node are candidates. Nodes are cut into
       blocks, pairs of blocks are compared by their labels, and what agrees well enough is joined
       into families.
    3. The families' texts are sent out by pairs of blocks, and every pair of texts is verified by its
       exact overlap. Only counts and one edge per text leave a pair of blocks.
    4. Connected components of those edges are the classes.

    So no pair is lost but those that share no node (``recall``) or whose signatures differ by chance
    by more than ``MARGIN``, about five standard deviations; no group is gathered, and pairs are
    counted without being emitted. A row with a NULL or empty text, or one of white space, has no
    shingle, no links, and is a class of its own with n_copies 1. Ids may be NULL or repeat: texts,
    not ids, are compared. An empty table gives an empty table. Other columns are not read.
    """
    keyed = df.select(F.col(doc).alias("doc"), text_key(F.col(text)).alias("key"), F.col(text).alias("text"))
    signed = materialize(sign_texts(keyed, "text", trees, label, words))
    texts = materialize(
        signed.where("n_shingles > 0").groupBy("key").agg(
            F.min("doc").alias("doc"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n_shingles"),
            F.first("labels").alias("labels"))
        .withColumn("tid", F.monotonically_increasing_id()))
    families = components(_family_edges(texts, threshold, trees, label, recall), "tid", "other")
    found = materialize(_verify(keyed, texts, families, words, threshold))
    links = found.groupBy("tid").agg(F.sum("links").alias("n_links"))
    linked = components(found.where("links > 0"), "tid", "other").select(
        F.col("node").alias("tid"), F.col("root").alias("class"))
    members = materialize(
        texts.select("tid", "key", "doc", "copies").join(links, "tid", "left").join(linked, "tid", "left")
        .select("key", "doc", "copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("class", "tid").alias("class")))
    smallest = members.groupBy("class").agg(F.min("doc").alias("class_id"), F.min("key").alias("class_key"))
    classes = members.join(smallest, "class").select(
        "key", "class_id", "class_key", "n_links", F.col("copies").alias("n_copies"))
    full = signed.where("n_shingles > 0").select("doc", "key").join(classes, "key").select(
        F.col("doc").alias(doc), F.col("key").alias("text_key"), "class_id", "class_key", "n_links", "n_copies")
    bare = signed.where("n_shingles = 0").select(
        F.col("doc").alias(doc), F.col("key").alias("text_key"), F.col("doc").alias("class_id"),
        F.lit(None).cast("binary").alias("class_key"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return full.unionByName(bare)


def _family_edges(texts: DataFrame, threshold: float, trees: int, label: int, recall: float) -> DataFrame:
    """(tid, other) edges that connect all texts of a trie node whose labels agree well enough."""
    least = prefix_depth(threshold, trees, label, recall)
    shared = materialize(matched_prefixes(texts, trees, label, least))
    placed = chosen_nodes(shared, least, depths_by_rank(threshold, trees, label, recall), label)
    sizes = placed.groupBy("of").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    values = min(SKETCH, trees * label)
    members = placed.join(sizes, "of").join(texts.select("tid", F.substring("labels", 1, 2 * values).alias("labels")), "tid")
    blocks = F.ceil(F.col("n") / BLOCK)
    return _pairs_of_blocks(members, blocks, "tid", "of").mapInArrow(
        lambda batches: _agreeing(batches, values, threshold - MARGIN), "tid long, other long")


def matched_prefixes(texts: DataFrame, trees: int, label: int, least: int) -> DataFrame:
    """(tid, tree, label) of the labels that share ``least`` values or more with another one of their
    tree. All labels are sorted over all tasks, where such labels lie next to one another, however
    many they are; the two at the ends of a task's range are kept unseen."""
    size = 2 * label
    labels = texts.select("tid", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), "labels").select(
        "tid", "tree", F.expr(f"substring(labels, tree * {size} + 1, {size})").alias("label"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, before = None, label
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [rest, batch])
            if not table.num_rows:
                continue
            values = np.frombuffer(b"".join(table.column("label").to_pylist()), np.uint16).reshape(-1, label)
            tree = table.column("tree").to_numpy()
            after = np.cumprod(values[1:] == values[:-1], axis=1).sum(axis=1) * (tree[1:] == tree[:-1])
            matched = np.maximum(np.concatenate([[before], after[:-1]])[: len(after)], after)
            yield from table.slice(0, len(after)).filter(pa.array(matched >= least)).to_batches()
            rest = table.slice(len(after)).combine_chunks().to_batches()[0]
            before = after[-1] if len(after) else before
        if rest is not None:
            yield rest

    ordered = labels.repartitionByRange("tree", "label").sortWithinPartitions("tree", "label")
    return ordered.mapInArrow(walk, labels.schema)


def chosen_nodes(shared: DataFrame, least: int, depths: list[int], label: int) -> DataFrame:
    """(tid, of): the trie nodes in which texts are compared. A node of ``least`` values with up to
    ``BLOCK`` texts is one. In larger ones a text asks for its node of the length that ``depths``
    gives for this one's rank among its large nodes, and takes the shortest node on its path that
    any text asks for, so all texts of a node that is asked for meet in it."""
    node = lambda depth: F.xxhash64("tree", F.substring("label", 1, 2 * depth))
    placed = shared.withColumn("of", node(least))
    placed = placed.join(placed.groupBy("of").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "of")
    large = placed.where(F.col("n") > BLOCK).select("tid", "tree", "label", "n")
    ranked = large.groupBy("tid").agg(F.sort_array(F.collect_list(F.struct("n", "tree", "label")), asc=False).alias("nodes"))
    asked = ranked.select(F.explode(F.transform("nodes", lambda x, rank: F.struct(
        x["tree"].alias("tree"), x["label"].alias("label"), F.get(F.lit(depths), rank).alias("depth")))).alias("at")).select("at.*")
    asked = asked.select(F.xxhash64("tree", F.expr("substring(label, 1, 2 * depth)")).alias("of")).distinct()
    path = large.select("tid", "tree", F.explode(F.array(*[
        F.struct(F.lit(d).alias("depth"), node(d).alias("of")) for d in range(least, label + 1)])).alias("at")).select("tid", "tree", "at.*")
    taken = path.join(asked, "of", "left_semi").groupBy("tid", "tree").agg(F.min(F.struct("depth", "of"))["of"].alias("of"))
    return placed.where(F.col("n") <= BLOCK).select("tid", "of").unionByName(taken.select("tid", "of"))


def _pairs_of_blocks(df: DataFrame, blocks, row: str, *group: str) -> DataFrame:
    """Each row once for every pair of blocks that its block is part of, dealt by group and pair, with
    ``low`` and ``high`` of the pair and the row's ``block``, rows of a pair together."""
    dealt = (
        df.withColumn("blocks", blocks.cast("long"))
        .withColumn("block", F.pmod(F.xxhash64(row), F.col("blocks")))
        .withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumn("low", F.least("block", "with")).withColumn("high", F.greatest("block", "with"))
        .drop("with", "blocks")
    )
    return dealt.repartition(*group, "low", "high").sortWithinPartitions(*group, "low", "high", row)


def _whole_groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that end where a group ends, with the number of each row's group. Rows come sorted by
    ``names``; a group is bounded by the size of its blocks."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        group = _group_numbers(table, names)
        cut = int(np.searchsorted(group, group[-1])) if len(group) else 0
        if cut:
            yield table.slice(0, cut), group[:cut]
        rest = table.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest, _group_numbers(rest, names)


def _group_numbers(table: pa.Table, names: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    for n in names:
        column = table.column(n).to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return np.cumsum(new)


def _agreeing(batches: Iterator[pa.RecordBatch], values: int, least: float) -> Iterator[pa.RecordBatch]:
    for table, group in _whole_groups(batches, ["of", "low", "high"]):
        tid = table.column("tid").to_numpy()
        sketch = np.frombuffer(b"".join(table.column("labels").to_pylist()), np.uint8)[::2].reshape(-1, values)
        block = table.column("block").to_numpy()
        mixed = table.column("low").to_numpy() != table.column("high").to_numpy()
        first, second = [], []
        at = live = np.arange(len(tid))
        for k in range(1, len(tid)):
            live = live[live < len(tid) - k]
            live = live[group[live] == group[live + k]]
            if not len(live):
                break
            i = live[~mixed[live] | (block[live] != block[live + k])]
            for part in range(0, len(i), 16_384):
                some = i[part : part + 16_384]
                some = some[(sketch[some] == sketch[some + k]).mean(axis=1) >= least]
                first.append(some)
                second.append(some + k)
        if not first:
            continue
        root = _roots(len(tid), np.concatenate(first), np.concatenate(second))
        other = root != at
        yield pa.RecordBatch.from_arrays([pa.array(tid[other]), pa.array(tid[root[other]])], ["tid", "other"])


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        keep = root[a] != root[b]
        a, b = a[keep], b[keep]
    while (root[root] != root).any():
        root = root[root]
    return root


def _verify(keyed: DataFrame, texts: DataFrame, families: DataFrame, words: int, threshold: float) -> DataFrame:
    """(tid, links, other): for each text and each pair of blocks the texts of the other block linked
    to it, and the smallest text it is connected with in this pair of blocks."""
    members = texts.select("tid", "key", "n_shingles").join(families, F.col("tid") == F.col("node"))
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles"))
    members = members.select("tid", "key", "root").join(sizes, "root")
    rows = _texts_of(keyed.select("key", "text"), members).join(members, "key")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in _whole_groups(batches, ["root", "low", "high"]):
            text = table.column("text").combine_chunks()
            sets = []
            for _, data, offsets in text_parts(text):
                hashes, starts = word_hashes(data, offsets)
                sets += [np.unique(shingle_hashes(hashes[s:e], words)) for s, e in zip(starts, starts[1:])]
            tid, block = table.column("tid").to_numpy(), table.column("block").to_numpy()
            low, high = table.column("low").to_numpy(), table.column("high").to_numpy()
            edges = np.flatnonzero(np.diff(group, prepend=-1))
            links, root = np.zeros(len(tid), np.int64), np.arange(len(tid))
            for s, e in zip(edges, [*edges[1:], len(tid)]):
                linked = similar(sets[s:e], threshold)
                if low[s] != high[s]:
                    linked &= block[s:e, None] != block[None, s:e]
                links[s:e] = linked.sum(axis=1)
                a, b = np.nonzero(np.triu(linked))
                root[s:e] = s + _roots(e - s, a, b)
            yield pa.RecordBatch.from_arrays([pa.array(tid), pa.array(links), pa.array(tid[root])], ["tid", "links", "other"])

    return _pairs_of_blocks(rows, blocks, "tid", "root").mapInArrow(check, "tid long, links long, other long")


def _texts_of(keyed: DataFrame, members: DataFrame) -> DataFrame:
    """One row for each key of ``members``, with its text, and some rows more. A bitmap of fixed size
    stops most other texts before the shuffle (all, but for chance, below some million keys; ever
    fewer beyond, with the same result), and copies become one row per task before it."""
    at, bit = F.xxhash64("key").bitwiseAND(F.lit(BITMAP - 1)), F.expr("cast(shiftrightunsigned(xxhash64(key), 58) as int)")
    bits = members.select(at.alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    near = keyed.withColumn("at", at).withColumn("bit", bit).join(F.broadcast(bits), "at").where("getbit(bits, bit) = 1")
    return near.select("key", "text").dropDuplicates(["key"])


def similar(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets have a Jaccard similarity of at least ``threshold``; none with itself.

    Elements of one set alone cannot overlap and are put aside. The rest are the columns of a 0/1
    matrix whose product with itself, taken in slices of columns, holds all overlaps.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    elements = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(n), sizes.astype(np.int64))
    order = np.argsort(elements, kind="stable")
    elements, row = elements[order], row[order]
    new = np.concatenate([[True], elements[1:] != elements[:-1]])[: len(elements)]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1 if len(column) else np.zeros(0, bool)
    row, column = row[shared], column[shared]
    column = np.cumsum(np.diff(column, prepend=-1) != 0) - 1
    overlap = np.zeros((n, n), np.float32)
    width = 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        s, e = np.searchsorted(column, [at, at + width])
        present = np.zeros((n, width), np.float32)
        present[row[s:e], column[s:e] - at] = 1
        overlap += present @ present.T
    out = overlap >= threshold * (sizes[:, None] + sizes[None, :] - overlap) - 1e-6
    out &= (sizes[:, None] > 0) & (sizes[None, :] > 0)
    np.fill_diagonal(out, False)
    return out


def one_of_each(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with one row of each class of ``near_duplicates``: that with the smallest ``doc``, and of
    several such the smallest text by its key. Rows of one ``doc`` and one text count once."""
    key, n, keep_key, keep_doc = fresh(df, "key", "n", "keep_key", "keep_doc")
    found = materialize(near_duplicates(df, doc, text))
    # Rows without words have no class_key; each stays, so their (doc, key) is taken once and not counted.
    counted = found.groupBy("class_key", F.col(doc).alias("doc"), F.col("text_key").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    best = counted.where("class_key IS NOT NULL").groupBy("class_key").agg(F.min(F.struct("doc", "key", "n")).alias("best")).select("best.*")
    bare = counted.where("class_key IS NULL").select("doc", "key", F.lit(1).cast("long").alias("n"))
    kept = best.unionByName(bare).select(F.col("doc").alias(keep_doc), F.col("key").alias(keep_key), F.col("n").alias(n))
    rows = df.withColumn(key, text_key(F.col(text))).join(
        kept, (F.col(key) == F.col(keep_key)) & F.col(doc).eqNullSafe(F.col(keep_doc)))
    once = rows.where(F.col(n) == 1).select(*df.columns)
    repeated = rows.where(F.col(n) > 1).groupBy(key, keep_doc).agg(F.min(F.struct(*df.columns)).alias("row")).select("row.*")
    return once.unionByName(repeated)
