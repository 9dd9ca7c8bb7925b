"""Queries over sources and indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from freqloom.functions import text as T
from freqloom.operators import index, search
from freqloom.sources import corpora, shards, sinks

from . import fixtures as X
from .catalog import query

W = "WITH "


@query("scan_corpus", "SELECT doc_id AS sample_id, source AS link, sha256(text) AS text FROM documents")
def scan_corpus(spark, d):
    return X.table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), F.col("source").alias("link"), F.sha2("text", 256).alias("text"))


@query("scan_dropna", "SELECT lang, count(*) AS n FROM (SELECT lang, nullif(text, '') AS text, nullif(CASE WHEN doc_id % 5 = 0 THEN '' ELSE source END, '') AS link FROM documents) WHERE text IS NOT NULL AND link IS NOT NULL GROUP BY lang")
def scan_dropna(spark, d):
    rows = X.table(spark, d, "documents").select("lang", "text", F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("source")).alias("link"))
    return corpora.drop_missing(rows, ["text", "link"]).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("rewrite_zip_join", "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, doc_id AS sample_id, sha256(upper(lang) || ' ' || source || text) AS line FROM documents")
def rewrite_zip_join(spark, d):
    docs = X.table(spark, d, "documents")
    lines = docs.select(F.col("doc_id").alias("item_id"), F.sha2(F.concat(F.upper("lang"), F.lit(" "), "source", "text"), 256).alias("line"))
    done = corpora.replace_by_position(docs.select("doc_id"), lines, ["doc_id"], ["item_id"], same=("doc_id", "item_id"))
    return done.select("idx", F.col("doc_id").alias("sample_id"), F.col("text").alias("line"))


@query("chunk_slice", "WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, count(*) OVER () AS total FROM documents) SELECT (idx // (total // 8 + 1))::BIGINT AS chunk_id, count(*) AS n, min(doc_id) AS lo, max(doc_id) AS hi FROM a GROUP BY 1")
def chunk_slice(spark, d):
    rows = X.table(spark, d, "documents").select("doc_id")
    return corpora.chunk(corpora.dense_index(rows, ["doc_id"]), rows.count(), 8).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))


CAPTIONS = "WITH i AS (SELECT conv_id, list(text ORDER BY turn, text) AS c FROM conversations GROUP BY conv_id), cap AS (SELECT conv_id, generate_subscripts(c[1:5], 1) - 1 AS pos, unnest(c[1:5]) AS caption FROM i)"


def captions(spark, d):
    return corpora.first_captions(X.table(spark, d, "conversations"), "conv_id", ["turn", "text"], "text")


@query("captions_flatten", CAPTIONS + " SELECT conv_id, pos::BIGINT AS pos, sha256(caption) AS caption FROM cap")
def captions_flatten(spark, d):
    return captions(spark, d).select("conv_id", F.col("pos").cast("long").alias("pos"), F.sha2("caption", 256).alias("caption"))


@query("concept_list", "SELECT n_name AS concept, 'tree' AS family FROM nation UNION ALL SELECT p_name, 'list' FROM part")
def concept_list(spark, d):
    """Concepts read from result trees, one for each region and half of its nations by each key, and from lists of one-key objects."""
    n = X.table(spark, d, "nation")
    half = [F.map_from_entries(F.collect_list(F.when(F.col("n_nationkey") % 2 == k, F.struct("n_name", F.lit("1"))))) for k in (0, 1)]
    trees = n.groupBy("n_regionkey").agg(F.to_json(F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array(F.struct(half[0].alias("classwise")), F.struct(half[1].alias("classwise"))))).alias("j"))
    lists = X.table(spark, d, "part").select(F.to_json(F.array(F.map_from_arrays(F.array("p_name"), F.array(F.array("p_type"))))).alias("j"))
    return corpora.concept_keys(trees, "j").withColumn("family", F.lit("tree")).unionByName(corpora.first_keys(lists, "j").withColumn("family", F.lit("list")))


@query("shard_key_parse", "SELECT lpad((doc_id // 100)::VARCHAR, 5, '0') || '/' || lpad(doc_id::VARCHAR, 8, '0') || '.jpg' AS name, lpad((doc_id // 100)::VARCHAR, 5, '0') AS shard, (doc_id // 100) * 10000 + doc_id AS sample_id, doc_id AS lead FROM documents WHERE doc_id % 3 = 0")
def shard_key_parse(spark, d):
    shard = F.floor(F.col("doc_id") / 100)
    rows = X.table(spark, d, "documents").select(F.concat(shards.shard_name(shard), F.lit("/"), shards.shard_name(F.col("doc_id"), 8), F.element_at(F.array(F.lit(".jpg"), F.lit(".json"), F.lit(".txt")), (F.col("doc_id") % 3 + 1).cast("int"))).alias("name"))
    return rows.where(F.lower("name").rlike(r"\.(jpg|jpeg|png)$")).select("name", F.split("name", "/")[0].alias("shard"), shards.sample_id(F.col("name")).alias("sample_id"), shards.leading_number(F.col("name")).alias("lead"))


@query("shard_range", "SELECT vec_id // 50 AS shard, count(*) AS n FROM embeddings WHERE vec_id // 50 >= 2 AND vec_id // 50 < 7 GROUP BY 1")
def shard_range(spark, d):
    rows = X.embeddings(spark, d).select(F.floor(F.col("vec_id") / 50).alias("shard"))
    return rows.where("shard >= 2 AND shard < 7").groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


@query("url_to_row", "SELECT page_id, url, row_number() OVER (ORDER BY page_id) - 1 AS row_idx FROM pages")
def url_to_row(spark, d):
    return corpora.url_rows(X.table(spark, d, "pages"), "url", ["page_id"]).select("page_id", "url", "row_idx")


@query("split_inventory", "WITH s AS (SELECT label, CASE WHEN vec_id % 10 < 7 THEN 'train' WHEN vec_id % 10 = 7 THEN 'val' ELSE 'test' END AS split FROM embeddings) SELECT split, label::BIGINT AS label, count(*) AS n, count(DISTINCT label) OVER () AS classes FROM s GROUP BY split, label")
def split_inventory(spark, d):
    m = F.col("vec_id") % 10
    rows = X.embeddings(spark, d).select(F.when(m < 7, "train").when(m == 7, "val").otherwise("test").alias("split"), F.col("label").cast("long").alias("label"))
    classes = rows.agg(F.count_distinct("label").alias("classes"))
    return rows.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(classes)).select("split", "label", "n", "classes")


@query("one_hot_tags", "SELECT vec_id, p::BIGINT AS pos, (label = p)::BIGINT AS bit FROM embeddings, range(10) t(p)")
def one_hot_tags(spark, d):
    return corpora.one_hot(X.embeddings(spark, d), "label", 10).select("vec_id", F.posexplode("bits").alias("pos", "bit")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("bit").cast("long").alias("bit"))


@query("text_normalize", "SELECT doc_id, sha256(regexp_replace(text, '[^A-Za-z ]', '', 'g')) AS cleaned FROM documents")
def text_normalize(spark, d):
    return X.table(spark, d, "documents").select("doc_id", F.sha2(T.clean(F.col("text")), 256).alias("cleaned"))


@query("query_terms", W + X.SQL_NAMES + ", " + X.SQL_TERMS + f" SELECT concept_id, concept, term, {T.lemma_sql('term')} AS lemma FROM terms")
def query_terms(spark, d):
    return search.concept_terms(X.names(spark, d)).select("concept_id", "concept", "term", T.lemma(F.element_at(F.split("term", "'"), -1)).alias("lemma"))


@query("unigram_postings", W + X.SQL_POST + ", " + X.SQL_LEMMAS + " SELECT term, count(*) AS n, min(sample_id) AS lo, max(sample_id) AS hi FROM lemma_post GROUP BY term")
def unigram_postings(spark, d):
    return index.unigram_postings(X.corpus(spark, d), index.nouns).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.min("sample_id").alias("lo"), F.max("sample_id").alias("hi"))


@query("phrase_postings", "WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents), p AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS phrase FROM t) SELECT phrase, count(*) AS n FROM p GROUP BY phrase")
def phrase_postings(spark, d):
    return index.doc_freq(index.phrase_postings(X.corpus(spark, d)), "phrase", many=True).withColumnRenamed("df", "n")


@query("term_doc_freq", W + X.SQL_DF + " SELECT term, df FROM df")
def term_doc_freq(spark, d):
    return index.doc_freq(index.unigram_postings(X.corpus(spark, d)))


@query("merge_chunk_index", W + X.SQL_POST + " SELECT term, sum(sample_id)::BIGINT AS ids, count(*) AS n FROM post GROUP BY term")
def merge_chunk_index(spark, d):
    docs = X.corpus(spark, d)
    size = 1 + docs.agg(F.max("sample_id")).first()[0] // 4
    local = docs.withColumns({"chunk_id": F.floor(F.col("sample_id") / size), "local_id": F.col("sample_id") % size})
    sizes = local.groupBy("chunk_id").agg((F.max("local_id") + 1).alias("n"))
    chunks = local.select("chunk_id", "local_id", F.explode(F.array_distinct(index.surface(F.col("text")))).alias("term"))
    return index.merge_chunks(chunks, sizes).groupBy("term").agg(F.sum("sample_id").alias("ids"), F.count(F.lit(1)).alias("n"))


@query("term_sharding", W + X.SQL_DF + ", o AS (SELECT term, row_number() OVER (ORDER BY md5(term), term) - 1 AS i, count(*) OVER () AS total FROM df) SELECT i // ((total + 15) // 16) AS shard, count(*) AS n, min(md5(term)) AS lo, max(md5(term)) AS hi FROM o GROUP BY 1")
def term_sharding(spark, d):
    terms = index.unigram_postings(X.corpus(spark, d)).select("term").distinct()
    return index.term_shards(terms, 16).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min(F.md5("term")).alias("lo"), F.max(F.md5("term")).alias("hi"))


@query("caption_remap", "SELECT doc_id AS sample_id, max(doc_id) OVER (PARTITION BY text) AS row_id FROM documents")
def caption_remap(spark, d):
    docs = X.corpus(spark, d).withColumn("text", F.sha2("text", 256))
    return index.remap_by_caption(docs, docs.withColumnRenamed("sample_id", "row_id"))


@query("sample_to_concepts", W + X.SQL_BOTH + ", t AS (SELECT sample_id, count(DISTINCT concept_id) AS n FROM hits GROUP BY 1), i AS (SELECT sample_id, count(DISTINCT concept_id) AS n FROM img WHERE prob > 0.6 GROUP BY 1) SELECT coalesce(t.sample_id, i.sample_id) AS sample_id, coalesce(t.n, 0) AS n_text_concepts, coalesce(i.n, 0) AS n_image_concepts FROM t FULL JOIN i ON t.sample_id = i.sample_id")
def sample_to_concepts(spark, d):
    t = index.by_sample(search.text_search(X.corpus(spark, d), X.concepts(spark)), "concept_id", "tc")
    i = index.by_sample(X.images(spark, d).where("prob > 0.6"), "concept_id", "ic")
    n = {f"n_{k}_concepts": F.coalesce(F.array_size(c), F.lit(0)).cast("long") for k, c in (("text", "tc"), ("image", "ic"))}
    return t.join(i, "sample_id", "full").withColumns(n).select("sample_id", *n)


CONCEPT_SQL = CAPTIONS + f", ct AS (SELECT DISTINCT conv_id, pos, {T.lemma_sql('w')} AS concept FROM (SELECT conv_id, pos, unnest(regexp_extract_all(lower(caption), '[a-z]+')) AS w FROM cap) WHERE length(w) > 1 AND w NOT IN {X.STOPS}), cx AS (SELECT concept, count(*) AS n_captions, count(DISTINCT conv_id) AS n_images FROM ct GROUP BY concept)"


def extracted(spark, d):
    rows = captions(spark, d).select("conv_id", "pos", F.explode(F.array_distinct(index.nouns(F.col("caption")))).alias("concept"))
    each = rows.groupBy("concept", "conv_id").agg(F.count(F.lit(1)).alias("c"))
    return each.groupBy("concept").agg(F.sum("c").alias("n_captions"), F.count(F.lit(1)).alias("n_images"))


@query("concept_extract", CONCEPT_SQL + " SELECT * FROM cx")
def concept_extract(spark, d):
    return extracted(spark, d)


@query("concept_min_support", CONCEPT_SQL + " SELECT concept, n_images FROM cx WHERE n_images >= 10")
def concept_min_support(spark, d):
    return extracted(spark, d).where("n_images >= 10").select("concept", "n_images")


@query("counts_union", W + X.SQL_BOTH + ", u AS (SELECT concept, 'a_text' AS source, count(*) AS n FROM hits GROUP BY concept UNION ALL SELECT concept, 'b_image', count(*) FROM img JOIN concepts USING (concept_id) WHERE prob > 0.6 GROUP BY concept) SELECT concept, source, n FROM (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY source) AS r FROM u) WHERE r = 1")
def counts_union(spark, d):
    c = X.concepts(spark)
    a = search.text_search(X.corpus(spark, d), c).groupBy("concept").agg(F.count(F.lit(1)).alias("n")).withColumn("source", F.lit("a_text"))
    b = X.images(spark, d).where("prob > 0.6").join(F.broadcast(c), "concept_id").groupBy("concept").agg(F.count(F.lit(1)).alias("n")).withColumn("source", F.lit("b_image"))
    return sinks.first_per_key(a.unionByName(b), ["concept"], ["source"])


@query("result_upsert", "SELECT label::BIGINT AS model, count(*) + CASE WHEN label % 2 = 0 THEN 1000 ELSE 0 END AS value FROM embeddings GROUP BY label")
def result_upsert(spark, d):
    old = X.embeddings(spark, d).groupBy(F.col("label").cast("long").alias("model")).agg(F.count(F.lit(1)).alias("value"))
    return sinks.upsert(old, old.where("model % 2 = 0").withColumn("value", F.col("value") + 1000), ["model"])


@query("first_per_key", "SELECT sha256(text) AS key, min(doc_id) AS doc_id FROM documents GROUP BY text")
def first_per_key(spark, d):
    rows = X.table(spark, d, "documents").select(F.sha2("text", 256).alias("key"), "doc_id")
    return sinks.first_per_key(rows, ["key"], ["doc_id"])


@query("map_merge", "SELECT key, arg_max(value, place) AS value FROM (SELECT event_id AS place, event_type || user_id AS key, value FROM events) GROUP BY key")
def map_merge(spark, d):
    rows = X.table(spark, d, "events").select(F.col("event_id").alias("place"), F.concat("event_type", F.col("user_id").cast("string")).alias("key"), "value")
    return sinks.merge_maps(rows, "key", "value", "place")
