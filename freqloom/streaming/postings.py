"""Incremental index maintenance: new caption files are appended to the postings as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from freqloom.operators.index import Analyzer, surface, unigram_postings


def maintain_postings(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, analyzer: Analyzer = surface) -> StreamingQuery:
    """Start a query that reads new Parquet files of (sample_id, text) and appends their postings once each.

    Each micro-batch writes a folder of its own number, so a batch that is repeated after a failure
    replaces itself.
    """
    docs = spark.readStream.schema(schema).parquet(source)

    def append(batch: DataFrame, number: int) -> None:
        unigram_postings(batch, analyzer).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return docs.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def postings(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target).drop("batch")
