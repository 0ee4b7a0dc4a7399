"""A corpus pipeline: reject poor documents, keep one of each near-duplicate group, mix the sources, encode.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of ``documents``. doc_id may be of any
type that can be ordered; rows are told apart by id and text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.llm.boosted_rules import reject_rule_breakers
from cartolith.llm.line_crf import reject_poor
from cartolith.llm.mixing import take
from cartolith.llm.near_dedup import keep_one_of_each
from cartolith.llm.queries import table, tokenizer_path
from cartolith.llm.storage import clear, mark, written
from cartolith.llm.trie_bpe import encode_documents


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return reject_poor(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The trees learn from the pipeline's input: after the stage before, hardly a bad document is left to learn from."""
    return reject_rule_breakers(docs, table(spark, sf_dir, "labels"), training=table(spark, sf_dir, "documents"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return take(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and digests of ids and decoded text, a row for each copy the mix takes."""
    coded = encode_documents(docs, tokenizer_path())
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("bpe", bpe),
]

#: The stages' models are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage wrote for itself, and its input, are deleted when its result is written."""
    docs, since = table(spark, sf_dir, "documents"), mark(spark)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline_{name}")
        clear(spark, since, keep=[docs])
    return STAGES[-1][1](spark, docs, sf_dir)
