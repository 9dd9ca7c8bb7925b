"""Scores of generated images: parsing, joining with prompts, aggregation per concept and model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATS = "array<struct<instance_id: string, stats: array<struct<name: struct<name: string>, sum: double, mean: double>>>>"


def parse_stats(rows: DataFrame, json_col: str) -> DataFrame:
    """(instance_id, pos, metric, sum, mean) of per-instance statistics; of repeated instances the first counts."""
    items = rows.select(F.posexplode(F.from_json(json_col, STATS)).alias("at", "i"))
    first = items.groupBy(F.col("i.instance_id").alias("instance_id")).agg(F.min_by("i.stats", "at").alias("stats"))
    return first.select("instance_id", F.posexplode("stats").alias("pos", "s")).select("instance_id", "pos", F.col("s.name.name").alias("metric"), F.col("s.sum").alias("sum"), F.col("s.mean").alias("mean"))


def read_prompts(rows: DataFrame, json_col: str) -> DataFrame:
    """(id, prompt) of lists [{id, input: {text}}]; of repeated ids the first counts."""
    items = rows.select(F.posexplode(F.from_json(json_col, "array<struct<id: string, input: struct<text: string>>>")).alias("at", "p"))
    return items.groupBy(F.col("p.id").alias("id")).agg(F.min_by("p.input.text", "at").alias("prompt"))


def task_name(file: Column) -> Column:
    """The task in a score file's name: its last two parts between underscores, up to the first dot."""
    parts = F.split(file, "_")
    return F.split(F.concat_ws("_", F.try_element_at(parts, F.lit(-2)), F.element_at(parts, -1)), r"\.")[0]


def score_rows(concepts: DataFrame, scores: DataFrame) -> DataFrame:
    """(concept, idx, scores): each concept's score vectors, a row for each, to be read in order of idx; null for an index out of range.

    concepts: (concept, idx); scores: (idx, scores array).
    """
    return concepts.join(scores, "idx", "left").select("concept", "idx", "scores")


def metric_range(stats: DataFrame, order: str, metric: str = "metric") -> DataFrame:
    """(metric, first, last): where a metric begins and ends in the list."""
    return stats.groupBy(metric).agg(F.min(order).alias("first"), F.max(order).alias("last"))


def attach(prompts: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """All prompts with their statistics; missing ones are null."""
    return prompts.join(stats, key, "left")


def aggregate(scores: DataFrame, by: list[str], concept: str, score: str) -> DataFrame:
    """([by], concept, mean, n) per concept and, with a null concept, over all; missing scores do not count, no score gives mean 0."""
    return scores.groupBy(*by, concept).agg(F.sum(score).alias("s"), F.count(score).alias("n")).groupingSets([[*by, concept], by], *by, concept).agg(F.sum("s").alias("s"), F.sum("n").alias("n")).select(*by, concept, mean_or_zero(F.col("s"), F.col("n")).alias("mean"), "n")


def mean_or_zero(total: Column, n: Column) -> Column:
    return F.coalesce(total / F.nullif(n, F.lit(0)), F.lit(0.0))


def combine(means: DataFrame, by: list[str]) -> DataFrame:
    """([by], mean): means of several data sets weighted by their numbers of scores."""
    return means.groupBy(*by).agg(mean_or_zero(F.sum(F.col("mean") * F.col("n")), F.sum("n")).alias("mean"))


def concept_means(scores: DataFrame, concept: str, score: str, more_than: int = 5) -> DataFrame:
    """(concept, mean) of concepts with over ``more_than`` scores."""
    return scores.groupBy(concept).agg(F.count(score).alias("n"), F.avg(score).alias("mean")).where(F.col("n") > more_than).select(concept, "mean")
