"""A corpus pipeline of four stages: quality, line and near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and
read again as the next stage's docs.  All but the last return the columns of documents, any other
columns included, whatever their names.  A null text is an empty one.  Repeated rows are judged alike
by the first two stages; of equal ids and texts near_dedup keeps one row, of other ties the smallest id
(a null id is smaller than any).  An empty table passes every stage and gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freqloom.llm.common import shared_dir
from freqloom.llm.compression_quality import keep_good
from freqloom.llm.line_dedup import drop_lines
from freqloom.llm.near_dedup import near_dedup
from freqloom.llm.packing import pack_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; n_chars follows the text that stays."""
    return drop_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that share 0.8 of their five-word shingles stays."""
    return near_dedup(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document in segments, and where each goes: bucket, shard and batch."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near_duplicates), ("packing", packing)]
#: Compressed sizes and XXH64 have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
