"""Queries through files: corpora, folders, split files, counts and hits, bucketed postings, chunks, variant and JSON lists, prompt banks.

Each writes what it makes of the given tables to the shared folder and reads it back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from freqloom.operators import index, prompts, search
from freqloom.sources import corpora, sinks, splits
from freqloom.sources.storage import shared_dir

from . import fixtures as X
from .catalog import query

W = "WITH "


def fresh(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("split_files", "SELECT CASE WHEN p_partkey % 10 < 7 THEN 'train' WHEN p_partkey % 10 = 7 THEN 'val' ELSE 'test' END AS split, p_type || '/' || p_partkey || '.jpg' AS path, p_size::INT AS label, p_name AS classname FROM part")
def split_files(spark, d):
    """Parts as items of a data set, in split files."""
    m = F.col("p_partkey") % 10
    rows = X.table(spark, d, "part").select(F.when(m < 7, "train").when(m == 7, "val").otherwise("test").alias("split"), F.concat("p_type", F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("path"), F.col("p_size").cast("int").alias("label"), F.col("p_name").alias("classname"))
    folder = fresh(spark, "splits")
    splits.write_split_json(rows, folder)
    return splits.load_dataset("food101")(spark, folder, suffix=".txt")


@query("count_files", "SELECT l_returnflag AS downstream, l_linestatus AS pt_dataset, 'text' AS method, 'part ' || l_partkey AS concept, count(*) AS n FROM lineitem GROUP BY ALL")
def count_files(spark, d):
    """Counts of parts as JSON objects in a folder for each flag, status and method."""
    counts = X.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("downstream"), F.col("l_linestatus").alias("pt_dataset"), F.lit("text").alias("method"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("concept")).agg(F.count(F.lit(1)).alias("n"))
    folder = fresh(spark, "counts")
    sinks.write_count_json(counts, folder)
    return sinks.read_count_json(spark, folder, suffix=".txt")


@query("hits_beside_counts", W + X.SQL_SEARCH + " SELECT concept, count(*) AS n, count(*) AS stored, sum(sample_id)::BIGINT AS ids FROM hits GROUP BY concept")
def hits_beside_counts(spark, d):
    """Hits of the text search and their counts, both written in folders by data set, corpus and method, met by concept."""
    key = [F.lit(v).alias(k) for k, v in zip(sinks.COUNT_KEYS, ("tables", "documents", "text"))]
    hits, counts = fresh(spark, "hits"), fresh(spark, "counts")
    sinks.write_hits(search.text_search(X.corpus(spark, d), X.concepts(spark)).select(*key, "concept", "sample_id"), hits)
    stored = sinks.read_hits(spark, hits).where("method = 'text'").groupBy(*sinks.COUNT_KEYS, "concept").agg(F.count(F.lit(1)).alias("stored"), F.sum("sample_id").alias("ids"))
    sinks.write_counts(stored.select(*sinks.COUNT_KEYS, "concept", F.col("stored").alias("n")), counts)
    return sinks.read_counts(spark, counts).where("method = 'text'").join(stored, [*sinks.COUNT_KEYS, "concept"]).select("concept", "n", "stored", "ids")


@query("bucketed_lookup", W + f"{X.SQL_CONCEPTS}, {X.SQL_TERMS}, {X.SQL_POST} SELECT term, count(*) AS df, sum(sample_id)::BIGINT AS ids FROM post WHERE term IN (SELECT term FROM terms) GROUP BY term")
def bucketed_lookup(spark, d):
    """The concepts' terms looked up in postings that lie in buckets by term: no posting is shuffled for the grouping."""
    folder = fresh(spark, "postings")
    table = f"postings_{folder[-32:]}"
    sinks.write_postings(index.unigram_postings(X.corpus(spark, d)), table, 16, path=folder)
    terms = search.concept_terms(X.concepts(spark)).select("term").distinct()
    return spark.table(table).join(F.broadcast(terms), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("sample_id").alias("ids"))


@query("chunks_once", W + X.SQL_POST + " SELECT term, count(*) AS df, sum(sample_id)::BIGINT AS ids FROM post GROUP BY term")
def chunks_once(spark, d):
    """Postings of two chunks of documents; a chunk that is there already is kept when it is written again."""
    folder, docs = fresh(spark, "chunks"), X.corpus(spark, d)
    for part in (docs, docs.where("sample_id < 0")):
        for k in range(2):
            sinks.write_once(index.unigram_postings(part.where(F.pmod("sample_id", F.lit(2)) == k)), f"{folder}/chunk={k}")
    return spark.read.parquet(folder).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("sample_id").alias("ids"))


@query("variant_files", "SELECT p_partkey::VARCHAR AS image_id, p_type AS classname FROM part WHERE p_type IN (SELECT p_type FROM part WHERE p_size < 10)")
def variant_files(spark, d):
    """Parts as lines "id class words"; classes are those of the small parts."""
    parts, lines, variants = X.table(spark, d, "part"), fresh(spark, "lines"), fresh(spark, "variants")
    parts.select(F.concat_ws(" ", F.col("p_partkey").cast("string"), "p_type").alias("value")).write.text(lines)
    parts.where("p_size < 10").select(F.col("p_type").alias("value")).distinct().write.text(variants)
    return splits.read_variants(spark, lines, variants).select("image_id", "classname")


SQL_LISTED = "l AS (SELECT p_partkey, (p_partkey // 50) || ' of ' || p_size AS concept, [p_name, p_brand] AS entries FROM part)"


@query("flat_lists", W + SQL_LISTED + " SELECT concept, arg_max(entries, p_partkey) AS entries FROM l GROUP BY concept")
def flat_lists(spark, d):
    """Lists of one-key objects, one for 50 parts, made flat; the last object of a key counts."""
    group = F.floor(F.col("p_partkey") / 50)
    item = F.create_map(F.concat(group.cast("string"), F.lit(" of "), F.col("p_size").cast("string")), F.array("p_name", "p_brand"))
    ordered = F.sort_array(F.collect_list(F.struct("p_partkey", F.to_json(item).alias("j"))))
    lists = X.table(spark, d, "part").groupBy(group).agg(F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda x: x["j"]), ", "), F.lit("]")).alias("value"))
    folder = fresh(spark, "flat")
    lists.select("value").write.text(folder)
    return sinks.read_flat_list(spark, folder, suffix=".txt")


#: Templates of the types of parts, in place of data sets: with an article, without one, with the places of a format.
BANKS = {
    "ECONOMY": ["A photo of {article} {c}.", "{c} on a shelf."],
    "STANDARD": ["Say what {} {} looks like:"],
    "PROMO": ["A view of {}", "{} seen from above", "Tell {} {} from others."],
    "LARGE": ["{c}"],
}
SQL_BANKS = "b AS (SELECT * FROM " + X.values([(s, t.replace("{} {}", "{article} {c}").replace("{}", "{c}")) for s, ts in BANKS.items() for t in ts], "dataset, template") + ")"


@query("prompt_banks", W + SQL_BANKS + " SELECT p_type AS dataset, p_name AS concept, 'set' AS mode, replace(replace(template, '{article}', CASE WHEN regexp_matches(lower(p_name), '^[aeiou]') THEN 'an' ELSE 'a' END), '{c}', p_name) AS prompt FROM part JOIN b ON dataset = p_type")
def prompt_banks(spark, d):
    """Each part in the templates of its own type; types without a bank have no prompts."""
    folder = fresh(spark, "banks")
    spark.range(1).select(F.to_json(F.struct(*[F.lit(t).alias(s) for s, t in BANKS.items()])).alias("value")).write.text(folder)
    parts = X.table(spark, d, "part").select(F.col("p_type").alias("dataset"), F.col("p_name").alias("concept"))
    return prompts.expand_sets(parts, prompts.read_banks(spark, folder, "set", suffix=".txt"))


SQL_LINES = "SELECT 'doc/' || doc_id AS link, sha256(nullif(regexp_replace(coalesce(text, ''), '[\\t\\r\\n]', ' ', 'g'), '')) AS text FROM documents"


@query("tsv_corpus", SQL_LINES)
def tsv_corpus(spark, d):
    """Documents as the tab-separated lines of a caption corpus, read by its reader; an empty text is null."""
    folder = fresh(spark, "tsv")
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\t\r\n]", " ")
    X.table(spark, d, "documents").select(F.concat(text, F.lit("\tdoc/"), F.col("doc_id").cast("string")).alias("value")).write.text(folder)
    return corpora.read_captions(spark, "cc3m", folder).select("link", F.sha2("text", 256).alias("text"))


@query("folder_classes", "SELECT 'type=' || p_type AS classname, (row_number() OVER (ORDER BY p_type) - 1)::INT AS label, n FROM (SELECT p_type, count(*) AS n FROM part GROUP BY p_type)")
def folder_classes(spark, d):
    """A folder for each type of part with a file of its parts: classes and labels of an image folder, and how much each holds."""
    folder = fresh(spark, "folders")
    X.table(spark, d, "part").select(F.col("p_type").alias("type"), F.col("p_partkey").cast("string").alias("value")).repartition("type").write.partitionBy("type").text(folder)
    classes = splits.read_folders(spark, folder).select("classname", "label").distinct()
    held = spark.read.text(folder, recursiveFileLookup=True).groupBy(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("classname")).agg(F.count(F.lit(1)).alias("n"))
    return classes.join(held, "classname").select("classname", "label", "n")
