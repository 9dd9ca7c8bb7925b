"""Writers: counts and hits by partition, index shards by bucket, upserts by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import json_lists
from .storage import dealt

COUNT_KEYS = ["downstream", "pt_dataset", "method"]


def write_counts(counts: DataFrame, path: str) -> None:
    counts.write.mode("append").partitionBy(*COUNT_KEYS).parquet(path)


def read_counts(spark, path: str) -> DataFrame:
    """Counts written by write_counts; files of JSON objects are read by read_count_json."""
    return spark.read.parquet(path)


def read_count_json(spark, path: str, suffix: str = "_search_counts.json", split: int = json_lists.SPLIT) -> DataFrame:
    """Counts of JSON objects {concept: n}, read in byte ranges.

    The keys are in names <downstream>_<corpus>_<method>_search_counts.json of files, or in those of
    folders, as write_count_json has it.  path: a file, or a folder of files with that suffix.
    """
    raw = json_lists.read_json_map(spark, path, "bigint", suffix, split).select("file", F.col("key").alias("concept"), F.col("value").alias("n"))
    name = F.split(F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"_search_counts\.json$", ""), "_", 3)
    folders = [F.nullif(F.regexp_extract("file", f"/{k}=([^/]*)/", 1), F.lit("")) for k in COUNT_KEYS]
    return raw.select(*[F.coalesce(f, F.get(name, F.lit(i))).alias(k) for i, (k, f) in enumerate(zip(COUNT_KEYS, folders))], "concept", "n")


def write_count_json(counts: DataFrame, path: str) -> None:
    """Counts as JSON objects {concept: n}, one on each line of text files, in a folder for each key (of letters, digits, ``-`` and ``_``)."""
    entry = F.to_json(F.create_map(F.col("concept"), F.col("n")))
    placed = counts.repartitionByRange(*COUNT_KEYS, "concept")
    placed.select(*COUNT_KEYS, entry.alias("value")).write.mode("append").partitionBy(*COUNT_KEYS).text(path)


def write_hits(hits: DataFrame, path: str) -> None:
    """Search hits (downstream, pt_dataset, method, concept, sample_id) beside their counts, a folder for each key.

    Files hold ranges of concepts and samples, so a concept with very many hits has several files and a
    look-up of a concept skips the others.
    """
    order = [*COUNT_KEYS, "concept", "sample_id"]
    hits.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).write.mode("append").partitionBy(*COUNT_KEYS).parquet(path)


def read_hits(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_postings(postings: DataFrame, table: str, buckets: int, term: str = "term", path: str | None = None) -> None:
    """Postings bucketed and sorted by term: lookups of few terms then read few buckets.

    A bucket is written by several tasks, each of which sorts its own rows; a frequent term has several files.
    path: where the files lie, in a folder that driver and executors share; without it the warehouse must be one.
    """
    bucket = F.pmod(F.hash(term), F.lit(buckets))  # as bucketBy has it
    writer = dealt(postings, bucket, groups=buckets).write.mode("overwrite").bucketBy(buckets, term).sortBy(term)
    (writer if path is None else writer.option("path", path)).saveAsTable(table)


def write_thresholds(postings: DataFrame, path: str) -> None:
    """An image index (threshold, concept_id, sample_id) with a folder for each threshold: a search reads its own only."""
    postings.repartition("threshold", "concept_id").sortWithinPartitions("threshold", "concept_id").write.mode("overwrite").partitionBy("threshold").parquet(path)


def write_image_index(postings: DataFrame, path: str) -> None:
    """An image index (corpus, threshold, concept_id, sample_id) with a folder for each corpus and threshold.

    Files hold ranges of concepts, so a large folder has several and a look-up skips most row groups.
    """
    order = ["corpus", "threshold", "concept_id", "sample_id"]
    postings.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("corpus", "threshold").parquet(path)


def write_map_json(maps: DataFrame, key: str, value: str, path: str) -> None:
    """A JSON object {key: value} on each line, one for each row, so that no map meets in one task."""
    maps.select(F.to_json(F.create_map(F.col(key).cast("string"), F.col(value))).alias("value")).write.mode("overwrite").text(path)


def write_once(rows: DataFrame, path: str) -> None:
    """Keep what is there already."""
    rows.write.mode("ignore").parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of new, and those of old whose key new does not have."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by the order columns (a grouped minimum with map-side combining)."""
    rest = [c for c in rows.columns if c not in (*keys, *order)]
    least = rows.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("__first"))
    return least.select(*keys, *[F.col("__first")[c].alias(c) for c in (*order, *rest)])


def read_flat_list(spark, path: str, suffix: str = ".json", split: int = json_lists.SPLIT) -> DataFrame:
    """(concept, entries) of lists of one-key objects [{concept: [entry, ...]}], read in byte ranges: the nested lists as flat rows.

    Of repeated concepts the last counts, by file and place.  path: a file, or a folder of files with that suffix.
    """
    items = json_lists.read_elements(spark, path, suffix, split)
    keys = items.select("file", "at", F.explode(F.from_json("element", "map<string, array<string>>")).alias("concept", "entries"))
    return keys.groupBy("concept").agg(F.max_by("entries", F.struct("file", "at")).alias("entries"))


def merge_maps(maps: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value) of the last row of each key: what updating one map by the next leaves."""
    return maps.groupBy(key).agg(F.max_by(value, order).alias(value))
