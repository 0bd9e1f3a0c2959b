"""How often the input is read, read off the plans."""

from pyspark.sql import functions as F

from tablewash.llm import sharding


def test_texts_are_not_read_again_for_boundaries(spark, monkeypatch):
    written, write = [], sharding.materialize
    monkeypatch.setattr(sharding, "materialize", lambda df: (
        written.append(df._jdf.queryExecution().optimizedPlan().toString()), write(df))[1])
    df = spark.createDataFrame([(i, "x" * (i % 5)) for i in range(60)], "k bigint, text string")
    done = sharding.contiguous_shards(df.select("k", F.octet_length("text").alias("size")), F.col("size"), 4, ["k"])
    assert [tuple(r) for r in done.groupBy("shard").agg(F.count("k"), F.sum("size"), F.max("slot")).orderBy("shard").collect()] == [
        (0, 15, 30, 14), (1, 15, 30, 14), (2, 15, 30, 14), (3, 15, 30, 14)]
    assert not any("RepartitionByExpression" in p and "octet_length" in p for p in written)
