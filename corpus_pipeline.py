"""Corpus pipeline over the documents table: five stages, each one operator of quarterdeck.llm.

A stage takes (spark, docs, sf_dir) and works on all rows of ``docs``, which its predecessor kept.
All but the last return the columns of documents. Rows that share a doc_id are one document: a
stage that drops an id drops its rows. Null ids and null texts pass every stage that filters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterdeck.llm.bitfilter import without_ids
from quarterdeck.llm.decontaminate import contamination
from quarterdeck.llm.mixing import mixed
from quarterdeck.llm.near_dup import near_duplicates
from quarterdeck.llm.sharding import byte_shards, measured
from quarterdeck.llm.tables import prepare, table
from quarterdeck.llm.toxicity import fit_chain, label_categories, without_category
from quarterdeck.session import cut_lineage

SHARDS = 40


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not call toxic."""
    model = fit_chain(docs, table(spark, sf_dir, "labels"), label_categories())
    return without_category(docs, model, "toxic")


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near copies.

    Rows that repeat an id with the same text are copies as well; one of them stays.
    """
    prepare(spark)
    found = cut_lineage(near_duplicates(docs, shingle=5, percent=80))
    left = without_ids(docs, found.where(~F.col("kept")).select("doc_id").distinct())
    repeated = cut_lineage(found.where(F.col("kept") & F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return left
    single = left.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns)
    return without_ids(left, repeated).unionByName(single)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    return without_ids(docs, cut_lineage(found.where("contaminated").select("doc_id").distinct()))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: rows as often as it takes them."""
    prepare(spark)
    return mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row."""
    return byte_shards(measured(docs), SHARDS)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicate),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]
#: The classifier cannot be said in SQL; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
