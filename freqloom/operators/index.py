"""Inverted indexes as long tables of (term, sample_id) postings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freqloom.functions.text import STOP_WORDS, lemma, tokens
from freqloom.sources.corpora import dense_index
from freqloom.sources.storage import dealt

#: Turns a text column into an array of index terms, repeats allowed.
Analyzer = Callable[[Column], Column]


def surface(text: Column) -> Column:
    """All tokens, as they stand (lower case)."""
    return tokens(text)


def cased(text: Column) -> Column:
    """All tokens with their case: capitalised ones are found by no lower-cased query term."""
    return tokens(text, keep_case=True)


def nouns(text: Column) -> Column:
    """Noun proxy: lemmas of tokens of two letters or more that are no stop words; a tagger can replace it."""
    kept = F.filter(F.array_distinct(tokens(text)), lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))
    return F.transform(kept, lemma)


def unigram_postings(corpus: DataFrame, analyzer: Analyzer = surface, id_col: str = "sample_id", text_col: str = "text") -> DataFrame:
    """(term, sample_id), distinct: a document's terms are made distinct in its own row, so nothing is shuffled."""
    return corpus.select(F.explode(F.array_distinct(analyzer(F.col(text_col)))).alias("term"), F.col(id_col).alias("sample_id"))


def phrase_postings(corpus: DataFrame, id_col: str = "sample_id", text_col: str = "text") -> DataFrame:
    """(phrase, sample_id): adjacent token pairs, distinct for each document."""
    made = F.transform(F.array(tokens(F.col(text_col))), lambda t: F.when(F.size(t) > 1, F.transform(F.sequence(F.lit(0), F.size(t) - 2), lambda i: F.concat_ws(" ", t[i], t[i + 1]))).otherwise(F.array().cast("array<string>")))[0]
    return corpus.select(F.explode(F.array_distinct(made)).alias("phrase"), F.col(id_col).alias("sample_id"))


def doc_freq(postings: DataFrame, term: str = "term", many: bool = False) -> DataFrame:
    """(term, df).  many: most terms are in few documents, such as pairs; rows are then dealt by term first, since counting in each task would keep nearly all of them."""
    return (dealt(postings, term) if many else postings).groupBy(term).agg(F.count(F.lit(1)).alias("df"))


def merge_chunks(chunks: DataFrame, sizes: DataFrame) -> DataFrame:
    """(term, sample_id) over all chunks: local ids are shifted by the sizes of the chunks before.

    chunks: (chunk_id, term, local_id); sizes: (chunk_id, n), one row per chunk, which is broadcast.
    """
    before = F.sum("n").over(Window.orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("chunk_id", F.coalesce(before, F.lit(0)).alias("offset"))
    return chunks.join(F.broadcast(offsets), "chunk_id").select("term", (F.col("local_id") + F.col("offset")).alias("sample_id"))


def term_shards(terms: DataFrame, shards: int) -> DataFrame:
    """(term, shard): terms in a random but repeatable order (of their MD5), cut into ranges of equal size, rounded up."""
    ordered = dense_index(terms.select(F.md5("term").alias("__md5"), "term"), ["__md5", "term"])
    size = -(-ordered.count() // shards)
    return ordered.select("term", F.floor(F.col("idx") / max(1, size)).cast("long").alias("shard"))


def image_postings(probs: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, concept_id, sample_id) of samples strictly above each threshold.

    Rows under the lowest threshold go before the thresholds multiply them.
    """
    above = F.filter(F.lit(sorted(thresholds)), lambda t: F.col("prob") > t)
    return probs.where(F.col("prob") > min(thresholds)).select(F.explode(above).alias("threshold"), "concept_id", "sample_id")


def with_empty(vocabulary: DataFrame, postings: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, concept, n): hits for every concept of the vocabulary, zero included."""
    every = vocabulary.select("concept_id", "concept", F.explode(F.lit(thresholds)).alias("threshold"))
    n = postings.groupBy("threshold", "concept_id").agg(F.count(F.lit(1)).alias("n"))
    return every.join(n, ["threshold", "concept_id"], "left").select("threshold", "concept", F.coalesce("n", F.lit(0)).alias("n"))


def remap_by_caption(shard: DataFrame, corpus: DataFrame) -> DataFrame:
    """(sample_id, row_id): corpus row of each shard sample by equal caption; of equal captions the last row counts."""
    last = corpus.groupBy("text").agg(F.max("row_id").alias("row_id"))
    return shard.join(last, "text").select("sample_id", "row_id")


def concept_maps(captions: DataFrame, id_col: str, pos: str, caption: str, least: int = 10, analyzer: Analyzer = nouns) -> dict[str, tuple[DataFrame, DataFrame]]:
    """{"captions": (rows, every), "images": (rows, every)}: which captions and images hold which kept concept.

    rows: (id, pos, concept) and (id, concept), each once, of concepts held by at least ``least`` images;
    read by concept or by id they are the four maps.  every: all captions and images, those without a
    kept concept included.
    """
    said = captions.select(id_col, pos, F.explode(F.array_distinct(analyzer(F.col(caption)))).alias("concept"))
    images = said.select(id_col, "concept").distinct()
    kept = images.groupBy("concept").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("concept")
    every = captions.select(id_col, pos)
    return {"captions": (said.join(kept, "concept"), every), "images": (images.join(kept, "concept"), every.select(id_col).distinct())}


def by_sample(postings: DataFrame, value: str, out: str) -> DataFrame:
    """The index turned round: each sample's distinct concepts."""
    return postings.groupBy("sample_id").agg(F.sort_array(F.collect_set(value)).alias(out))
