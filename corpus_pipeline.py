"""The corpus pipeline: its stages in order, each a function (spark, docs, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewash.llm import decontaminate, near_dups, packing, quality, secrets
from tablewash.llm.common import fresh, materialize, read
from tablewash.llm.queries import tokenizer_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the verdicts on hosts keep."""
    # Whole rows travel as one column, so that none of theirs meets a column of the verdicts.
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text", "source")
    return quality.host_verdicts(quality.measure(rows)).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies and near copies."""
    return near_dups.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.without_passages(docs, read(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; n_chars follows where a text changed."""
    (findings,) = fresh(docs, "findings")
    found = secrets.find_secrets(docs, out=findings)
    text = secrets.redact(F.col("text"), F.col(findings))
    n_chars = F.when(F.size(findings) > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    # The length first: it is taken from the text as it was, with the mark put in once.
    return found.withColumn("n_chars", n_chars).withColumn("text", text).select(*docs.columns)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens, with their token ids."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", sequence_packing),
]

#: The similarity searches, the forest and the packing have no SQL form; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
