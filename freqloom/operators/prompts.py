"""Prompts for text encoders and for models that describe concepts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freqloom.functions.text import plain_name
from freqloom.sources import json_lists

#: The line every description starts from, the questions, and the answers asked for each.
SEED = "a photo of a {c}."
QUESTIONS = [
    "Describe concisely what a(n) {c} looks like:",
    "How can you identify a(n) {c} concisely?",
    "What does a(n) {c} look like concisely?",
    "What are the identifying characteristics of a(n) {c}:",
    "Please provide a concise description of the visual characteristics of {c}:",
]
ANSWERS = 10


def filled(concept: str) -> Column:
    """The column template with the concept for {c} and its a or an for {article}."""
    article = F.when(F.lower(concept).rlike("^[aeiou]"), "an").otherwise("a")
    return F.replace(F.replace("template", F.lit("{article}"), article), F.lit("{c}"), F.col(concept))


def expand(concepts: DataFrame, templates: DataFrame, concept: str = "concept") -> DataFrame:
    """(concept, mode, prompt): every concept in every template; {c} is the concept, {article} its a or an.

    templates: (mode, template), a few hundred rows at most; they are broadcast.
    """
    return concepts.select(concept).join(F.broadcast(templates)).select(concept, "mode", filled(concept).alias("prompt"))


def read_banks(spark: SparkSession, path: str, mode: str, suffix: str = ".json") -> DataFrame:
    """(dataset, mode, template) of prompt banks, JSON objects {data set: [template, ...]}.

    ``{} {}`` stands for an article and the concept, another ``{}`` for the concept.  A template that stands
    twice in the bank of a set is one.
    """
    t = F.replace(F.replace("value", F.lit("{} {}"), F.lit("{article} {c}")), F.lit("{}"), F.lit("{c}"))
    banks = json_lists.read_json_lists(spark, path, "string", suffix)
    return banks.select(F.col("key").alias("dataset"), F.lit(mode).alias("mode"), t.alias("template")).where("template IS NOT NULL").distinct()


def expand_sets(concepts: DataFrame, banks: DataFrame, concept: str = "concept") -> DataFrame:
    """(dataset, concept, mode, prompt): concepts (dataset, concept) in the templates of their own data set.

    A join by data set; Spark sends the banks to all tasks if they are small, else splits a large set.  A set
    without a bank has no prompts; of several modes in banks, each gives its prompts.
    """
    return concepts.select("dataset", concept).join(banks, "dataset").select("dataset", concept, "mode", filled(concept).alias("prompt"))


def label_texts(concepts: DataFrame, templates: DataFrame, concept: str = "concept") -> DataFrame:
    """(concept, mode, prompt) with plain names; prompts that start with "a" or "the" get "This is " before them."""
    made = expand(concepts.select(plain_name(F.col(concept)).alias(concept)), templates, concept)
    return made.withColumn("prompt", F.when(F.startswith("prompt", F.lit("a")) | F.startswith("prompt", F.lit("the")), F.concat(F.lit("This is "), "prompt")).otherwise(F.col("prompt")))


def description_requests(concepts: DataFrame, known: DataFrame, concept: str = "concept") -> DataFrame:
    """(concept, place, line) for concepts without descriptions: the seed line at place 0, then each question once for each answer."""
    lines = [SEED, *[q for q in QUESTIONS for _ in range(ANSWERS)]]
    open_ones = concepts.select(concept).join(known.select(concept), concept, "left_anti")
    return open_ones.select(concept, F.posexplode(F.lit(lines)).alias("place", "t")).select(concept, F.col("place").cast("long").alias("place"), F.replace("t", F.lit("{c}"), F.col(concept)).alias("line"))
