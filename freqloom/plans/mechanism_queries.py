"""Queries over tar archives, annotation lists, bitmap postings, the positional and the maintained index."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from freqloom.operators import bitmaps, index, phrases, search
from freqloom.sources import json_lists, shards, sinks, tar
from freqloom.sources.storage import shared_dir
from freqloom.streaming import corrections

from . import fixtures as X
from .catalog import query

W = "WITH "


@query("tar_round_trip", "SELECT doc_id AS sample_id, lpad((doc_id // 100)::VARCHAR, 5, '0') AS shard, sha256(coalesce(text, '')) AS text FROM documents WHERE doc_id % 3 = 0")
def tar_round_trip(spark, d):
    """Documents written as members of tar archives and, those of one extension, read back by byte ranges."""
    doc = F.col("doc_id")
    kind = F.when(doc % 3 == 0, ".txt").otherwise(".json")
    rows = X.table(spark, d, "documents").select(F.concat(shards.shard_name(F.floor(doc / 100)), F.lit("/"), shards.shard_name(doc, 8), kind).alias("name"), F.coalesce("text", F.lit("")).alias("content"))
    folder = f"{shared_dir(spark)}/tar-{uuid.uuid4().hex}"
    written = tar.write_tar(rows, folder)
    written.agg(F.sum("members")).collect()
    found = tar.read_members(spark, folder, split=1 << 20, names=".txt")
    return found.select(shards.leading_number(F.col("name")).alias("sample_id"), F.split("name", "/")[0].alias("shard"), F.sha2("content", 256).alias("text"))


@query("bitmap_text_search", W + X.SQL_SEARCH + " SELECT concept, sample_id FROM hits")
def bitmap_text_search(spark, d):
    """Text search over bitmap postings."""
    made = bitmaps.bitmap_postings(index.unigram_postings(X.corpus(spark, d)))
    return bitmaps.hits(bitmaps.bitmap_search(made, X.concepts(spark))).select("concept", "sample_id")


@query("bitmap_doc_freq", W + X.SQL_DF + " SELECT term, df FROM df")
def bitmap_doc_freq(spark, d):
    return bitmaps.doc_freq(bitmaps.bitmap_postings(index.unigram_postings(X.corpus(spark, d))))


SQL_PHRASES = "WITH q AS (SELECT item_id, (regexp_extract_all(lower(text), '[a-z]+'))[1:2 + item_id % 4] AS p FROM benchmark), t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents), j AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS line FROM t), h AS (SELECT item_id, len(list_filter(range(1, len(w) - len(p) + 2), lambda i: w[i:i + len(p) - 1] = p)) AS n FROM q, j WHERE len(p) > 0 AND contains(line, ' ' || array_to_string(p, ' ') || ' '))"


@query("phrase_search", SQL_PHRASES + " SELECT item_id AS phrase_id, count(*) AS docs, sum(n)::BIGINT AS n FROM h GROUP BY item_id")
def phrase_search(spark, d):
    """Documents with the first two to five words of each benchmark item, one after the other, and how often."""
    words = index.surface(F.col("text"))
    asked = X.table(spark, d, "benchmark").select(F.col("item_id").alias("phrase_id"), F.array_join(F.slice(words, 1, (F.col("item_id") % 4 + 2).cast("int")), " ").alias("phrase"))
    post = phrases.positional_postings(X.corpus(spark, d), only=phrases.phrase_terms(asked))
    return phrases.phrase_search(post, asked).groupBy("phrase_id").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n"))


@query("annotation_list", "SELECT 'img/' || doc_id || '.jpg' AS image_path, pos::INT AS pos, sha256(coalesce(CASE pos WHEN 0 THEN text ELSE source END, '')) AS caption, [doc_id % 10, 10 + pos] AS caption_tags, [doc_id % 10, 10, 11] AS image_tags FROM documents, (VALUES (0), (1)) v(pos)")
def annotation_list(spark, d):
    """Documents as annotated images in JSON lists of 100, read back by byte ranges."""
    docs = X.table(spark, d, "documents")
    tag = F.col("doc_id") % 10
    longs = lambda *c: F.array(*[x.cast("long") for x in c])
    item = F.struct(
        F.concat(F.lit("img/"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("image_path"),
        F.array(F.coalesce("text", F.lit("")), F.coalesce("source", F.lit(""))).alias("caption"),
        longs(tag, F.lit(10), F.lit(11)).alias("union_label_id"),
        F.array(longs(tag, F.lit(10)), longs(tag, F.lit(11))).alias("parse_label_id"),
    )
    lists = docs.groupBy(F.floor(F.col("doc_id") / 100)).agg(F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(item)), ", "), F.lit("]")).alias("value"))
    folder = f"{shared_dir(spark)}/lists-{uuid.uuid4().hex}"
    lists.select("value").write.text(folder)
    rows = json_lists.read_json_list(spark, folder, json_lists.ANNOTATION, suffix=".txt", split=1 << 20)
    each = rows.select("image_path", F.posexplode("caption").alias("pos", "caption"), F.col("union_label_id").alias("image_tags"), "parse_label_id")
    return each.select("image_path", "pos", F.sha2("caption", 256).alias("caption"), "image_tags", F.get("parse_label_id", F.col("pos")).alias("caption_tags"))


SQL_NOW = "now AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN coalesce(source, '') || ' changed ' || coalesce(text, '') ELSE text END AS text FROM documents), w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM now)"


@query("maintained_index", W + SQL_NOW + " SELECT term, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM w GROUP BY term")
def maintained_index(spark, d):
    """Documents indexed as a stream; then every third changes, every seventh is removed, and old versions come again."""
    doc = F.col("doc_id")
    docs = X.table(spark, d, "documents").select(doc.alias("sample_id"), "text", "source")
    source, target, checkpoint = (f"{shared_dir(spark)}/index-{uuid.uuid4().hex}/{x}" for x in ("documents", "index", "checkpoint"))
    first = docs.select("sample_id", F.lit(1).cast("long").alias("version"), "text")
    text = F.when(F.col("sample_id") % 7 != 0, F.concat(F.coalesce("source", F.lit("")), F.lit(" changed "), F.coalesce("text", F.lit(""))))
    changed = docs.where("sample_id % 3 = 0 OR sample_id % 7 = 0").select("sample_id", F.lit(2).cast("long").alias("version"), text.alias("text"))
    for rows in (first, changed.unionByName(first.where("sample_id % 2 = 0"))):
        rows.write.mode("append").parquet(source)
        corrections.maintain(spark, source, target, checkpoint, fan=2).awaitTermination()
    return corrections.postings(spark, target).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("sample_id").alias("ids"))


@query("requested_search", W + X.SQL_IMG + ", r AS (SELECT n_nationkey AS request_id, n_nationkey % 3 AS corpus, [0.5, 0.6, 0.7][1 + n_nationkey % 3]::DOUBLE AS threshold, (n_nationkey % 10)::BIGINT AS concept_id FROM nation WHERE n_regionkey = 1) SELECT request_id::BIGINT AS request_id, sample_id FROM r JOIN img ON img.concept_id = r.concept_id AND sample_id % 3 = corpus AND prob > threshold")
def requested_search(spark, d):
    """Hits of a table of requests in an image index with folders by corpus and threshold."""
    made = index.image_postings(X.images(spark, d), [0.5, 0.6, 0.7]).withColumn("corpus", (F.col("sample_id") % 3).cast("int"))
    folder = f"{shared_dir(spark)}/images-{uuid.uuid4().hex}"
    sinks.write_image_index(made, folder)
    key = F.col("n_nationkey")
    wanted = X.table(spark, d, "nation").where("n_regionkey = 1").select(key.cast("long").alias("request_id"), (key % 3).cast("int").alias("corpus"), F.element_at(F.lit([0.5, 0.6, 0.7]), (key % 3 + 1).cast("int")).alias("threshold"), (key % 10).cast("long").alias("concept_id"))
    return search.requested(spark.read.parquet(folder), wanted)
