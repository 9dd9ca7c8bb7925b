"""Concept search over texts, tagged images and both."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freqloom.functions.text import capitalised, concept_key, query_terms

from .index import Analyzer, surface, unigram_postings

#: Up to this many query terms travel inside the plan; beyond, terms and postings are joined.
INLINE_TERMS = 20_000
#: And up to so many terms of one concept have a bit each.
MASK = 63


def concept_terms(concepts: DataFrame) -> DataFrame:
    """(concept_id, concept, term): distinct terms of each concept."""
    return concepts.select("concept_id", "concept", F.explode(query_terms(F.col("concept"))).alias("term"))


def text_search(corpus: DataFrame, concepts: DataFrame, analyzer: Analyzer = surface, id_col: str = "sample_id", text_col: str = "text") -> DataFrame:
    """(concept_id, concept, sample_id): texts that hold all known terms of a concept.

    A term no text holds is dropped from its concept; a concept without known terms has no hits.  Each
    row is cut to the query's terms it holds and gives one row for each concept that has one of them: a
    mask of the concept's terms.  The masks are brought together by (concept, sample), mostly in their
    own task, and a concept's known terms are those in any mask.  The corpus is read once.
    """
    terms = concept_terms(concepts)
    few = terms.select("concept_id", "term").limit(INLINE_TERMS + 1).collect()
    sizes = Counter(r.concept_id for r in few)
    if len(few) > INLINE_TERMS or max(sizes.values(), default=0) > MASK:
        return text_search_postings(unigram_postings(corpus, analyzer, id_col, text_col), concepts)
    vocabulary = sorted({r.term for r in few})
    held = F.filter(analyzer(F.col(text_col)), lambda t: t.isin(vocabulary))  # a hash set, built once
    postings = corpus.select(F.explode(F.array_distinct(held)).alias("term"), F.col(id_col).alias("sample_id"))
    nth = F.row_number().over(Window.partitionBy("concept_id").orderBy("term")) - 1
    numbered = terms.select("concept_id", "term", F.call_function("shiftleft", F.lit(1).cast("long"), nth).alias("bit"))
    met = postings.join(F.broadcast(numbered), "term")  # at most INLINE_TERMS rows
    masks = met.groupBy("concept_id", "sample_id").agg(F.bit_or("bit").alias("mask"))
    known = masks.groupBy("concept_id").agg(F.bit_or("mask").alias("known"))
    hits = masks.join(F.broadcast(known), "concept_id").where("mask = known")
    return hits.join(F.broadcast(concepts.select("concept_id", "concept")), "concept_id").select("concept_id", "concept", "sample_id")


def text_search_postings(postings: DataFrame, concepts: DataFrame) -> DataFrame:
    """The same by relational division over a materialised index: a concept's known terms are counted and matched."""
    terms = concept_terms(concepts)
    hits = postings.join(terms, "term")
    needed = terms.join(postings.select("term").distinct(), "term", "left_semi").groupBy("concept_id").agg(F.count(F.lit(1)).alias("needed"))
    got = hits.groupBy("concept_id", "concept", "sample_id").agg(F.count(F.lit(1)).alias("got"))
    return got.join(needed, "concept_id").where("got = needed").select("concept_id", "concept", "sample_id")


def counts(hits: DataFrame, concepts: DataFrame) -> DataFrame:
    """(concept_id, concept, n), zero included."""
    n = hits.groupBy("concept_id").agg(F.count(F.lit(1)).alias("n"))
    return concepts.join(n, "concept_id", "left").select("concept_id", "concept", F.coalesce("n", F.lit(0)).alias("n"))


def integrated(text_hits: DataFrame, image_hits: DataFrame, concepts: DataFrame) -> DataFrame:
    """(concept, n_text, n_image, n_both) by one grouped pass over both kinds of hits; hits count once each.

    Text and image hits of a concept meet by (concept, sample), a well-spread key.
    """
    marked = text_hits.select("concept_id", "sample_id", F.lit(1).alias("t"), F.lit(0).alias("i")).unionByName(image_hits.select("concept_id", "sample_id", F.lit(0).alias("t"), F.lit(1).alias("i")))
    each = marked.groupBy("concept_id", "sample_id").agg(F.max("t").alias("t"), F.max("i").alias("i"))
    n = each.groupBy("concept_id").agg(F.sum("t").alias("n_text"), F.sum("i").alias("n_image"), F.sum(F.col("t") * F.col("i")).alias("n_both"))
    return concepts.join(n, "concept_id", "left").select("concept", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_text", "n_image", "n_both")])


def subset(hits: DataFrame, keep: DataFrame) -> DataFrame:
    """Hits of the listed samples, each once."""
    return hits.join(keep.select("sample_id").distinct(), "sample_id", "left_semi").dropDuplicates(["concept_id", "sample_id"])


def requested(index: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, sample_id): hits of a table of requests (request_id, corpus, threshold, concept_id).

    index: as sinks.write_image_index has it.  The requests, filtered, decide at run time which folders are
    read (dynamic partition pruning), so a search of one corpus reads no other.
    """
    return index.join(requests, ["corpus", "threshold", "concept_id"]).select("request_id", "sample_id")


def misalignment(text_hits: DataFrame, image_hits: DataFrame, corpus_size: DataFrame) -> DataFrame:
    """(n_mis, degree_extracted, degree_fixed): samples with concepts in both modalities but none in common.

    Counted without gathering concept sets: samples in both, less those with an equal (concept, sample)
    pair.  corpus_size: one row, column n.
    """
    marked = text_hits.select("sample_id", "concept_id", F.lit(1).alias("t"), F.lit(0).alias("i")).unionByName(image_hits.select("sample_id", "concept_id", F.lit(0).alias("t"), F.lit(1).alias("i")))
    pairs = marked.groupBy("sample_id", "concept_id").agg(F.max("t").alias("t"), F.max("i").alias("i"))
    samples = pairs.groupBy("sample_id").agg(F.max("t").alias("t"), F.max("i").alias("i"), F.max(F.col("t") * F.col("i")).alias("both"))
    total = samples.agg(F.coalesce(F.sum(F.col("t") * F.col("i") * (1 - F.col("both"))), F.lit(0)).alias("n_mis"), F.sum("t").alias("n_text"), F.sum("i").alias("n_image"))
    larger = F.greatest("n_text", "n_image")
    return total.join(F.broadcast(corpus_size)).select("n_mis", F.round(F.col("n_mis") / larger, 6).alias("degree_extracted"), F.round(F.col("n_mis") / F.col("n"), 6).alias("degree_fixed"))


def tag_of(concepts: DataFrame, tags: DataFrame) -> DataFrame:
    """(concept_id, concept, tag): the tag under which each concept's images are indexed.

    tags: the index's distinct tags.  A concept's own spelling comes first, then its case variants in
    their order, then any tag with the same key (lower case, underscores as spaces), the least of them;
    a concept without any has a null tag.  No variant is made: a tag that is one has the key of the
    concept's words, and which of its words are capitalised is its place in the order.
    """
    name, tag = F.col("concept"), F.col("tag")
    found = F.filter(F.split(name, r"[_\s]+"), lambda w: w != "")
    words = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("")))
    spaced = F.lower(F.array_join(words, " "))
    asked = concepts.where(name.isNotNull()).select("concept_id", "concept", words.alias("words"), F.explode(F.array_distinct(F.array(concept_key(name), spaced))).alias("key"))
    met = asked.join(tags.select("tag", concept_key(tag).alias("key")), "key")
    capitals = F.zip_with("words", F.split(tag, "_"), lambda w, p: F.when(p == F.lower(w), 0).when(p == capitalised(w), 1))
    variant = ~F.exists(capitals, lambda c: c.isNull())
    place = F.when(tag == name, F.array(F.lit(-1))).when(variant, capitals).when(F.col("key") == concept_key(name), F.array(F.lit(2)))
    placed = met.select("concept_id", "tag", place.alias("place")).where("place IS NOT NULL")
    best = placed.groupBy("concept_id").agg(F.min_by("tag", F.struct("place", "tag")).alias("tag"))
    return concepts.select("concept_id", "concept").join(best, "concept_id", "left")


def tagged_hits(postings: DataFrame, concepts: DataFrame) -> DataFrame:
    """(concept_id, concept, sample_id) of concepts looked up in an image index of (tag, sample_id)."""
    return postings.join(tag_of(concepts, postings.select("tag").distinct()), "tag").select("concept_id", "concept", "sample_id")
