"""A positional index and the search for phrases of any length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .index import Analyzer, surface


def positional_postings(corpus: DataFrame, analyzer: Analyzer = surface, id_col: str = "sample_id", text_col: str = "text", only: DataFrame | None = None) -> DataFrame:
    """(term, sample_id, positions): where each term stands in each document, ascending from 0.

    only: a table of terms; others go before anything is shuffled.
    """
    found = corpus.select(F.col(id_col).alias("sample_id"), F.posexplode(analyzer(F.col(text_col))).alias("pos", "term"))
    if only is not None:
        found = found.join(only.select("term").distinct(), "term", "left_semi")
    return found.groupBy("term", "sample_id").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def phrase_terms(phrases: DataFrame, analyzer: Analyzer = surface) -> DataFrame:
    """(phrase_id, place, term, words): the terms of each phrase in order; words: how many it has."""
    cut = phrases.select("phrase_id", analyzer(F.col("phrase")).alias("t"))
    return cut.select("phrase_id", F.size("t").alias("words"), F.posexplode("t").alias("place", "term")).select("phrase_id", "place", "term", "words")


def phrase_search(postings: DataFrame, phrases: DataFrame, analyzer: Analyzer = surface) -> DataFrame:
    """(phrase_id, sample_id, n): how often each document has the terms of a phrase one after the other.

    postings: a positional index.  A phrase's rarest term tells in which documents it can stand; only
    there do the other terms' positions, shifted by their places, meet in an ordered intersection.  A
    phrase without terms, or with one that no document has, is found nowhere.
    """
    terms = phrase_terms(phrases, analyzer)
    df = postings.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rare = terms.join(df, "term").groupBy("phrase_id").agg(F.min_by("term", F.struct("df", "place")).alias("term"), F.count(F.lit(1)).alias("known"), F.max("words").alias("words"))
    rare = rare.where("known = words").select("phrase_id", "term")
    places = postings.join(rare, "term").select("phrase_id", "sample_id")
    met = postings.join(terms, "term").join(places, ["phrase_id", "sample_id"], "left_semi")
    shifted = F.transform("positions", lambda p: p - F.col("place"))
    each = met.groupBy("phrase_id", "sample_id").agg(F.collect_list(shifted).alias("starts"), F.max("words").alias("words")).where(F.size("starts") == F.col("words"))
    common = F.aggregate(F.slice("starts", 2, F.size("starts")), F.element_at("starts", 1), lambda s, x: F.array_intersect(s, x))
    return each.select("phrase_id", "sample_id", F.size(common).cast("long").alias("n")).where("n > 0")
