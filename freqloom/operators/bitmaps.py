"""Postings as bitmaps: (term, bucket, bits), a bit for each of the 32,768 sample ids of a bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freqloom.sources.storage import cut, dealt

from .search import concept_terms

#: Fixed value: ids of one of Spark's bitmap buckets.
BITS = 32_768


def bitmap_postings(postings: DataFrame, term: str = "term", id_col: str = "sample_id") -> DataFrame:
    """(term, bucket, bits) of (term, sample_id); equal ids count once.

    Postings are dealt by term and bucket, at most BITS different ones each, so bitmaps (4 KiB however few their bits)
    are neither shuffled nor sorted.
    """
    sample = F.col(id_col).cast("long")
    rows = postings.select(term, F.bitmap_bucket_number(sample).alias("bucket"), F.bitmap_bit_position(sample).alias("bit"))
    return dealt(rows, term, "bucket").groupBy(term, "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def doc_freq(bitmaps: DataFrame, term: str = "term") -> DataFrame:
    """(term, df), from the bitmaps alone."""
    return bitmaps.groupBy(term).agg(F.sum(F.bitmap_count("bits")).alias("df"))


def ids_of(bucket: Column, bits: Column) -> Column:
    """The ids of a bitmap as an array, by its bytes that aren't zero."""
    places = F.lit([[k for k in range(8) if value >> k & 1] for value in range(256)])

    def id_at(p: Column) -> Column:
        return F.when(bucket > 0, (bucket - 1) * BITS + p + 1).otherwise(bucket * BITS - p)

    def of_bits(x: Column) -> Column:
        byte = lambda b: F.substring(x, b + 1, F.lit(1))
        held = F.filter(F.sequence(F.lit(0), F.lit(BITS // 8 - 1)), lambda b: byte(b) != F.lit(b"\0"))
        return F.flatten(F.transform(held, lambda b: F.transform(F.get(places, F.conv(F.hex(byte(b)), 16, 10).cast("int")), lambda k: id_at(b * 8 + k))))

    return F.transform(F.array(bits), of_bits)[0]


def bitmap_search(bitmaps: DataFrame, concepts: DataFrame) -> DataFrame:
    """(concept_id, concept, bucket, bits): samples that hold all known terms of a concept, as bitmaps that aren't empty.

    A concept's bitmaps of a bucket meet there, and only where its rarest known term has any; a term no
    document has is dropped from its concept, a concept without known terms has no rows.  The concepts' bitmaps
    are made once and kept in the shared folder.
    """
    terms = concept_terms(concepts)
    held = cut(bitmaps.join(terms.select("term").distinct(), "term", "left_semi"))
    known = terms.join(doc_freq(held), "term")
    least = known.groupBy("concept_id").agg(F.min_by("term", F.struct("df", "term")).alias("term"), F.count(F.lit(1)).alias("needed"))
    where = held.join(least, "term").select("concept_id", "bucket", "needed")
    met = held.join(known.select("concept_id", "concept", "term"), "term").join(where, ["concept_id", "bucket"])
    both = met.groupBy("concept_id", "concept", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("n"), F.max("needed").alias("needed")).where("n = needed")
    return both.select("concept_id", "concept", "bucket", "bits").where(F.bitmap_count("bits") > 0)


def hits(found: DataFrame) -> DataFrame:
    """(concept_id, concept, sample_id) of bitmap_search's result."""
    return found.select("concept_id", "concept", F.explode(ids_of(F.col("bucket"), F.col("bits"))).alias("sample_id"))
