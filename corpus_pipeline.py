"""A corpus pipeline: each stage works on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsemill.llm import packing, quality_rules, simhash, toxicity
from pulsemill.llm.common import only, table, written
from pulsemill.llm.queries import split_pattern, vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a learned rule rejects go. Null texts fail the base rule."""
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules, prefix="__q_").where("__q_kept").select(*docs.columns)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.3 or more go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, out="__t_score").where("__t_score < 0.3").select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Groups are linked by op5's fingerprints and by five-word shingles of similarity 0.8. Of each, the row with the smallest
    doc_id stays (a null one only if there is no other); of several such rows, the one that was written first. Rows go by a
    number of their own, so rows with one doc_id and different texts are told apart."""
    numbered = written(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    of = simhash.groups(numbered.select(F.col("__row").alias("row"), "doc_id", "text"), similarity=0.8)
    of = written(of.select(F.col("row").alias("__row"), "doc_id", "component"), "groups")
    first = of.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row")).alias("first"))
    copies = of.select("__row").join(first.select("first.__row"), "__row", "left_anti")
    return only(numbered, copies, "__row", "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of 1024 tokens, each window in the mixture of the sources."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.tiktoken"), split_pattern())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("toxicity", without_toxic),
    ("simhash_dedup", without_copies),
    ("packing", packed),
]

#: Learned verdicts, fingerprints and tokens are beyond SQL: run() is tested against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
