"""The corpus pipeline: documents -> packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs.  All stages but the last
return the columns of ``documents``.  Stages accept null values in any column,
empty tables and further columns, which they drop.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyspark.llm import linedup, mixing, packing, setsketch, toxicity
from tallyspark.llm.common import read_table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the lexicon predicts to be toxic (score >= 0.3)."""
    lexicon = toxicity.learn(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, lexicon, threshold=0.3, keep=COLUMNS).where("predicted = 0").select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines on six or more sources, except in their first document;
    documents of which nothing is left go."""
    out = linedup.remove_boilerplate(docs.select(*COLUMNS), min_sites=6, min_words=3)
    return out.where((F.col("lines_removed") == 0) | (F.trim(F.col("text")) != "")).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document (the smallest id) of each group linked at a similarity of 0.8."""
    found = setsketch.near_duplicates(docs, percent=80)
    kept = found.where("kept").select(F.col("doc_id").alias("id"), "row_hash").distinct()
    same = docs["doc_id"].eqNullSafe(kept["id"]) & F.xxhash64(docs["text"]).eqNullSafe(kept["row_hash"])
    # equal ids with other texts of the same component and repeated rows: one stays
    rows = docs.join(kept, same).select(*[docs[c] for c in COLUMNS])
    repeated = written(kept.groupBy("id").count().where("count > 1"), "repeated").take(1)
    plain = docs.groupBy("doc_id").count().where("count > 1").take(1)
    return rows.dropDuplicates(["doc_id", "text"] if repeated else ["doc_id"]) if repeated or plain else rows


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents by probabilities whose shares are raked under the bound of one."""
    return mixing.mix(docs.select(*COLUMNS), bounded=True).where("sampled").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack every document into sequences of 2048 tokens."""
    out = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048, 1)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", toxicity_stage), ("line_dedup", line_dedup_stage), ("near_dedup", near_dedup_stage),
          ("mixing", mixing_stage), ("packing", packing_stage)]

# The learnt lexicon and the tokens cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
