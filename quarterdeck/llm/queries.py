"""One query per operator of this folder, over the driver's whole tables, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterdeck.llm.collocations import collocations
from quarterdeck.llm.decontaminate import contamination
from quarterdeck.llm.line_dedup import fuzzy_lines
from quarterdeck.llm.main_text import extract_main_text
from quarterdeck.llm.mixing import mix_to_targets
from quarterdeck.llm.near_dup import near_duplicates
from quarterdeck.llm.neighbors import nearest
from quarterdeck.llm.prefix_trie import ordered_turns, prefix_trie, share_openings
from quarterdeck.llm.repeated_spans import repeat_digests
from quarterdeck.llm.secrets import find_secrets
from quarterdeck.llm.sharding import byte_shards, measured
from quarterdeck.llm.tables import table
from quarterdeck.llm.token_files import token_digests
from quarterdeck.llm.toxicity import fit_chain, label_categories, score_chain


def op1_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = byte_shards(measured(table(spark, sf_dir, "documents")), 40)
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(vocabulary), end_id=1)


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_to_targets(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_chain(docs, table(spark, sf_dir, "labels"), label_categories())
    return score_chain(docs, model).withColumn("toxic", F.col("p_toxic") >= model.threshold("toxic"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op10_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(share_openings(ordered_turns(table(spark, sf_dir, "conversations"))))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(table(spark, sf_dir, "documents"), length=100)


QUERIES = {
    "op1_neighbors": op1_neighbors,
    "op2_shards": op2_shards,
    "op3_decontaminate": op3_decontaminate,
    "op4_secrets": op4_secrets,
    "op5_token_files": op5_token_files,
    "op6_mix": op6_mix,
    "op7_toxicity": op7_toxicity,
    "op8_main_text": op8_main_text,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_fuzzy_lines": op10_fuzzy_lines,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_collocations": op12_collocations,
    "op13_repeated_spans": op13_repeated_spans,
}
