"""Queries over concept search, image tags and their combination."""

from __future__ import annotations

from pyspark.sql import functions as F

from freqloom.operators import index, search

from . import fixtures as X
from .catalog import query

W = "WITH "


def text_hits(spark, d):
    return search.text_search(X.corpus(spark, d), X.concepts(spark))


def image_hits(spark, d, threshold=0.6):
    return X.images(spark, d).where(F.col("prob") > threshold)


@query("text_search_and", W + X.SQL_SEARCH + " SELECT concept, sample_id FROM hits")
def text_search_and(spark, d):
    return text_hits(spark, d).select("concept", "sample_id")


LEMMA_HITS = X.SQL_HITS.replace("known", "lknown").replace("need", "lneed").replace("hits", "lhits").replace("post", "lemma_post")


@query("text_search_counts", W + X.SQL_SEARCH + ", " + X.SQL_LEMMAS + ", " + LEMMA_HITS + " SELECT 'lowercased' AS method, c.concept, count(h.sample_id) AS n FROM concepts c LEFT JOIN hits h USING (concept_id) GROUP BY 2 UNION ALL SELECT 'lemmatized', c.concept, count(h.sample_id) FROM concepts c LEFT JOIN lhits h USING (concept_id) GROUP BY 2")
def text_search_counts(spark, d):
    c, docs = X.concepts(spark), X.corpus(spark, d)
    by = {"lowercased": index.surface, "lemmatized": index.nouns}
    parts = [search.counts(search.text_search(docs, c, a), c).select(F.lit(m).alias("method"), "concept", "n") for m, a in by.items()]
    return parts[0].unionByName(parts[1])


@query("text_search_division", W + X.SQL_SEARCH + " SELECT concept, count(*) AS n FROM hits GROUP BY concept")
def text_search_division(spark, d):
    return search.text_search_postings(index.unigram_postings(X.corpus(spark, d)), X.concepts(spark)).groupBy("concept").agg(F.count(F.lit(1)).alias("n"))


@query("image_probs", W + X.SQL_IMG + " SELECT sample_id AS vec_id, concept_id AS label, prob FROM img")
def image_probs(spark, d):
    return X.images(spark, d).select(F.col("sample_id").alias("vec_id"), F.col("concept_id").alias("label"), "prob")


@query("image_postings", W + X.SQL_CONCEPTS + ", " + X.SQL_IMG + f", t AS (SELECT unnest({X.THRESHOLDS}::DOUBLE[]) AS threshold) SELECT threshold, concept, count(img.sample_id) AS n FROM concepts CROSS JOIN t LEFT JOIN img ON img.concept_id = concepts.concept_id AND prob > threshold GROUP BY threshold, concept")
def image_postings(spark, d):
    return index.with_empty(X.concepts(spark), index.image_postings(X.images(spark, d), X.THRESHOLDS), X.THRESHOLDS)


@query("image_search_counts", W + X.SQL_CONCEPTS + ", " + X.SQL_IMG + " SELECT concept, count(img.sample_id) AS n FROM concepts LEFT JOIN img ON img.concept_id = concepts.concept_id AND prob > 0.6 GROUP BY concept")
def image_search_counts(spark, d):
    return search.counts(image_hits(spark, d), X.concepts(spark)).select("concept", "n")


@query("integrated_search", W + X.SQL_BOTH + ", i AS (SELECT concept_id, sample_id FROM img WHERE prob > 0.6), b AS (SELECT coalesce(h.concept_id, i.concept_id) AS concept_id, h.sample_id AS t, i.sample_id AS i FROM hits h FULL JOIN i ON h.concept_id = i.concept_id AND h.sample_id = i.sample_id) SELECT concept, count(t) AS n_text, count(i) AS n_image, count(*) FILTER (WHERE t IS NOT NULL AND i IS NOT NULL) AS n_both FROM concepts LEFT JOIN b USING (concept_id) GROUP BY concept")
def integrated_search(spark, d):
    return search.integrated(text_hits(spark, d), image_hits(spark, d), X.concepts(spark))


@query("missing_concepts", W + X.SQL_SEARCH + " SELECT concept FROM concepts WHERE concept_id NOT IN (SELECT concept_id FROM known)")
def missing_concepts(spark, d):
    held = search.concept_terms(X.concepts(spark)).join(index.unigram_postings(X.corpus(spark, d)).select("term"), "term", "left_semi")
    return X.concepts(spark).join(held.select("concept_id"), "concept_id", "left_anti").select("concept")


@query("subset_filter", W + X.SQL_CONCEPTS + ", " + X.SQL_IMG + " SELECT concept, count(DISTINCT sample_id) AS n FROM img JOIN concepts USING (concept_id) WHERE prob > 0.6 AND sample_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY concept")
def subset_filter(spark, d):
    keep = X.table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("sample_id"))
    kept = search.subset(image_hits(spark, d), keep).groupBy("concept_id").agg(F.count(F.lit(1)).alias("n"))
    return kept.join(F.broadcast(X.concepts(spark)), "concept_id").select("concept", "n")


@query("threshold_partition", W + X.SQL_CONCEPTS + ", " + X.SQL_IMG + " SELECT concept, count(*) AS n FROM img JOIN concepts USING (concept_id) WHERE prob > 0.7 GROUP BY concept")
def threshold_partition(spark, d):
    rows = index.image_postings(X.images(spark, d), X.THRESHOLDS).where(F.col("threshold") == 0.7)
    return rows.groupBy("concept_id").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(X.concepts(spark)), "concept_id").select("concept", "n")


@query("misalignment", W + X.SQL_BOTH + ", i AS (SELECT concept_id, sample_id FROM img WHERE prob > 0.6), p AS (SELECT coalesce(h.sample_id, i.sample_id) AS s, max(h.sample_id IS NOT NULL) AS t, max(i.sample_id IS NOT NULL) AS im, max(h.sample_id IS NOT NULL AND i.sample_id IS NOT NULL) AS both_ FROM hits h FULL JOIN i ON h.concept_id = i.concept_id AND h.sample_id = i.sample_id GROUP BY 1), a AS (SELECT count(*) FILTER (WHERE t AND im AND NOT both_) AS n_mis, count(*) FILTER (WHERE t) AS nt, count(*) FILTER (WHERE im) AS ni FROM p) SELECT n_mis, round(n_mis / greatest(nt, ni), 6) AS degree_extracted, round(n_mis / (SELECT count(*) FROM documents), 6) AS degree_fixed FROM a")
def misalignment(spark, d):
    size = X.table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n"))
    return search.misalignment(text_hits(spark, d), image_hits(spark, d), size)


@query("threshold_sweep", W + X.SQL_BOTH + f", t AS (SELECT unnest({X.THRESHOLDS}::DOUBLE[]) AS threshold), c AS (SELECT concept_id, count(*) AS n FROM hits GROUP BY 1), m AS (SELECT threshold, concept_id, count(*) AS n FROM img, t WHERE prob > threshold GROUP BY ALL) SELECT threshold, round(corr(ln(c.n), ln(m.n)), 6) AS r FROM c JOIN m USING (concept_id) GROUP BY threshold")
def threshold_sweep(spark, d):
    c = text_hits(spark, d).groupBy("concept_id").agg(F.count(F.lit(1)).alias("n"))
    m = index.image_postings(X.images(spark, d), X.THRESHOLDS).groupBy("threshold", "concept_id").agg(F.count(F.lit(1)).alias("m"))
    return m.join(F.broadcast(c), "concept_id").groupBy("threshold").agg(F.round(F.corr(F.log("n"), F.log("m")), 6).alias("r"))
