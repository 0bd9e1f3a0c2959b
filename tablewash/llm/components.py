"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewash.llm.common import materialize

#: Edges that one task of a round handles at least.
EDGES_OF_TASK = 100_000

def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge; the root is the smallest node of the component.

    Large-star and small-star steps in turn (Kiveris et al., 2014): each hangs neighbours under the
    smallest node known next to them, and after a number of rounds that grows with the logarithm
    of the longest path every component is a star. No node's neighbours are gathered: a node's
    smallest neighbour is an aggregate, and it is joined back to the edges. Every round is written
    to the shared folder, which cuts the lineage. Self loops and repeated edges do no harm; an edge
    with a NULL end is dropped.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    now = materialize(edges.where(F.col(a) != F.col(b)).select(u.alias("u"), v.alias("v")).distinct())
    before = None
    while (state := _state(now)) != before:
        before = state
        if not state[0]:
            break
        # No more tasks than the edges can fill: the driver keeps a record of each task of each round.
        tasks = -(-state[0] // EDGES_OF_TASK)
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).coalesce(tasks)
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks).distinct().coalesce(tasks)
        parent = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
        small = large.join(parent, "u").select(
            F.explode(F.when(F.col("v") == F.col("m"), F.array(F.struct("u", F.col("m").alias("v")))).otherwise(
                F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))).alias("e")).select("e.*").coalesce(tasks).distinct()
        now = materialize(small.coalesce(tasks))
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple[int, object]:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
