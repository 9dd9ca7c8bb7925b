"""Queries that relate frequency to performance, concept maps, and look-ups under other spellings."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from freqloom.functions import stats as S
from freqloom.operators import curate as C
from freqloom.operators import evaluate as E
from freqloom.operators import generated as G
from freqloom.operators import index, search
from freqloom.sources import splits
from freqloom.sources.storage import cut

from . import fixtures as X
from .catalog import query
from .curation_queries import SQL_ACC, SQL_BUCKETS
from .index_queries import CONCEPT_SQL, captions
from .string_queries import bins_sql

W = "WITH "


def title(word: str) -> str:
    return word[:1].upper() + word[1:].lower()


def variants(concept: str) -> list[str]:
    words = concept.replace("_", " ").split()
    return ["_".join(x) for x in product(*[(w.lower(), title(w)) for w in words])]


#: Every spelling under which a concept is looked up, the concept's own first.
SPELLED = [(i, n, s) for i, c in enumerate(X.CONCEPTS) for n, s in enumerate([c, *variants(c)])]
#: Images are tagged by concepts in three spellings: as it is, in title case, in capitals.
SQL_TAGGED = X.SQL_CONCEPTS + ", " + X.SQL_IMG + ", named AS (SELECT concept_id, CASE concept_id % 3 WHEN 0 THEN concept WHEN 1 THEN array_to_string(list_transform(regexp_split_to_array(concept, '[_ ]'), lambda w: upper(w[1]) || lower(w[2:])), '_') ELSE upper(replace(concept, ' ', '_')) END AS tag FROM concepts), tagged AS (SELECT tag, sample_id FROM img JOIN named USING (concept_id) WHERE prob > 0.6)"


def tagged(spark, d):
    words = F.split("concept", "[_ ]")
    titled = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), "_")
    kind = F.col("concept_id") % 3
    named = X.concepts(spark).select("concept_id", F.when(kind == 0, F.col("concept")).when(kind == 1, titled).otherwise(F.upper(F.replace("concept", F.lit(" "), F.lit("_")))).alias("tag"))
    return X.images(spark, d).where("prob > 0.6").join(F.broadcast(named), "concept_id").select("tag", "sample_id")


SQL_LOOKUP = SQL_TAGGED + f", spelled AS (SELECT * FROM {X.values(SPELLED, 'concept_id, nth, tag')}), tags AS (SELECT DISTINCT tag FROM tagged), exact AS (SELECT concept_id, arg_min(tag, nth) AS tag FROM spelled JOIN tags USING (tag) GROUP BY 1), alike AS (SELECT concept_id, min(tag) AS tag FROM concepts JOIN tags ON lower(replace(concept, '_', ' ')) = lower(replace(tag, '_', ' ')) GROUP BY 1), found AS (SELECT c.concept_id, concept, coalesce(e.tag, a.tag) AS tag FROM concepts c LEFT JOIN exact e USING (concept_id) LEFT JOIN alike a USING (concept_id))"


@query("image_search_variants", W + SQL_LOOKUP + " SELECT concept, found.tag, count(sample_id) AS n FROM found LEFT JOIN tagged USING (tag) GROUP BY concept, found.tag")
def image_search_variants(spark, d):
    n = cut(tagged(spark, d).groupBy("tag").agg(F.count(F.lit(1)).alias("n")))
    return search.tag_of(X.concepts(spark), n).join(n, "tag", "left").select("concept", "tag", F.coalesce("n", F.lit(0)).alias("n"))


@query("integrated_search_variants", W + SQL_LOOKUP + ", " + X.SQL_TERMS + ", " + X.SQL_POST + ", " + X.SQL_HITS + ", i AS (SELECT concept_id, sample_id FROM found JOIN tagged USING (tag)) SELECT concept, (SELECT count(*) FROM hits h WHERE h.concept_id = c.concept_id) AS n_text, (SELECT count(*) FROM i WHERE i.concept_id = c.concept_id) AS n_image, (SELECT count(*) FROM hits h JOIN i USING (concept_id, sample_id) WHERE concept_id = c.concept_id) AS n_both FROM concepts c")
def integrated_search_variants(spark, d):
    c = X.concepts(spark)
    return search.integrated(search.text_search(X.corpus(spark, d), c), search.tagged_hits(cut(tagged(spark, d)), c), c)


@query("cased_postings", "WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS term FROM documents) SELECT term, count(*) AS n FROM t WHERE term <> lower(term) GROUP BY term")
def cased_postings(spark, d):
    """Terms that a lower-cased query never finds in an index that keeps the case."""
    return index.doc_freq(index.unigram_postings(X.corpus(spark, d), index.cased)).where(F.col("term") != F.lower("term")).withColumnRenamed("df", "n")


SQL_MAPS = CONCEPT_SQL + ", kept AS (SELECT concept FROM cx WHERE n_images >= 10), c AS (SELECT conv_id, pos, concept FROM ct JOIN kept USING (concept)), ic AS (SELECT DISTINCT conv_id, concept FROM c), ci AS (SELECT DISTINCT conv_id FROM cap)"


#: Conversations whose members of a key are put in order together.
TOGETHER = 4096


def members(rows, key: str, order: list[str], name):
    """(key, n, members): the SHA-256 of each key's members in order, joined by commas; put in order by ranges of the first column, a text for each, so that a key's rows don't meet in a task."""
    ranged = rows.groupBy(key, F.floor(F.col(order[0]) / TOGETHER).alias("at")).agg(F.sort_array(F.collect_list(F.struct(*order, name.alias("name")))).alias("m"))
    texts = ranged.select(key, "at", F.size("m").alias("c"), F.array_join(F.transform("m", lambda x: x["name"]), ",").alias("text"))
    whole = F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda x: x["text"])
    return texts.groupBy(key).agg(F.sum("c").alias("n"), F.sha2(F.array_join(whole, ","), 256).alias("members"))


@query("concept_maps", SQL_MAPS + """ SELECT 'concept to captions' AS map, concept AS key, count(*) AS n, sha256(string_agg(conv_id || ':' || pos, ',' ORDER BY conv_id, pos)) AS members FROM c GROUP BY concept
UNION ALL SELECT 'concept to images', concept, count(*), sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) FROM ic GROUP BY concept
UNION ALL SELECT 'caption to concepts', cap.conv_id || ':' || cap.pos, count(concept), sha256(coalesce(string_agg(concept, ',' ORDER BY concept), '')) FROM cap LEFT JOIN c ON cap.conv_id = c.conv_id AND cap.pos = c.pos GROUP BY cap.conv_id, cap.pos
UNION ALL SELECT 'image to concepts', ci.conv_id::VARCHAR, count(concept), sha256(coalesce(string_agg(concept, ',' ORDER BY concept), '')) FROM ci LEFT JOIN ic ON ci.conv_id = ic.conv_id GROUP BY ci.conv_id""")
def concept_maps(spark, d):
    """Each key of the four maps with its number of members and the digest of their list, in order."""
    maps = index.concept_maps(captions(spark, d), "conv_id", "pos", "caption", least=10)
    ids = {"captions": F.concat_ws(":", "conv_id", "pos"), "images": F.col("conv_id").cast("string")}
    parts = []
    for kind, (rows, every) in maps.items():
        cols = ["conv_id", "pos"] if kind == "captions" else ["conv_id"]
        by_concept = members(rows, "concept", cols, ids[kind])
        parts.append(by_concept.select(F.lit(f"concept to {kind}").alias("map"), F.col("concept").alias("key"), "n", "members"))
        by_id = every.join(rows, cols, "left").groupBy(*cols).agg(F.sort_array(F.collect_list("concept")).alias("m"))
        parts.append(by_id.select(F.lit(f"{kind[:-1]} to concepts").alias("map"), ids[kind].alias("key"), F.size("m").cast("long").alias("n"), F.sha2(F.array_join("m", ","), 256).alias("members")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("label_samples", "SELECT label::BIGINT AS label, 'class ' || label AS classname, string_agg('v/' || vec_id, ',' ORDER BY 'v/' || vec_id) AS paths FROM embeddings GROUP BY label")
def label_samples(spark, d):
    """Each label with its class and the list of its samples."""
    rows = X.embeddings(spark, d).select(F.col("label").cast("long").alias("label"), F.concat(F.lit("v/"), F.col("vec_id").cast("string")).alias("path"), F.concat(F.lit("class "), F.col("label").cast("string")).alias("classname"))
    return splits.class_list(rows).join(splits.samples_of(rows), "label").select("label", "classname", F.array_join("paths", ",").alias("paths"))


# Entities are parts with names of several words, counted by their line items; each line item is an
# answer, right if it was not returned.
SQL_ENTITIES = "e AS (SELECT p_partkey AS id, count(l_orderkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey WHERE p_name LIKE '% %' AND p_partkey % 9 <> 0 GROUP BY p_partkey), df AS (SELECT id AS term, n AS df FROM e WHERE n > 0)"
SQL_GROUPS = "WITH RECURSIVE " + SQL_ENTITIES + SQL_BUCKETS.replace("1000", "50").replace(">= 100", ">= 20").replace("SELECT (k - 1)", ", bk AS (SELECT (k - 1)") + "), s AS (SELECT *, sum(n) OVER (ORDER BY bucket) - n AS start FROM bk), r AS (SELECT term, row_number() OVER (ORDER BY df DESC, term) - 1 AS rank FROM df), a AS (SELECT l_partkey AS term, (l_returnflag <> 'R')::INT AS answer FROM lineitem), m AS (SELECT s.bucket, s.n, s.lo, s.hi, avg(answer) AS mean, count(*) AS answers FROM s JOIN r ON rank >= start AND rank < start + s.n JOIN a USING (term) GROUP BY ALL)"


def bucket_means(spark, d):
    parts, lines = X.table(spark, d, "part"), X.table(spark, d, "lineitem")
    named = parts.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 9 != 0, F.col("p_name")).otherwise(F.regexp_replace("p_name", " ", "")).alias("entity"))
    counts = lines.groupBy(F.col("l_partkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    entities = C.several_words(named, "entity").join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))
    answers = lines.select(F.col("l_partkey").alias("id"), (F.col("l_returnflag") != "R").cast("double").alias("answer"))
    return C.bucket_answers(entities, answers, "id", "n", size=50, least=20)


@query("bucket_means", SQL_GROUPS + " SELECT bucket, n, lo, hi, round(mean, 6) AS mean, answers FROM m")
def bucket_mean_query(spark, d):
    return bucket_means(spark, d).withColumn("mean", X.r6(F.col("mean")))


@query("bucket_sizes", SQL_GROUPS + " SELECT min(answers) AS least, round(avg(answers), 6) AS mean, max(answers) AS most, min(n) AS entities FROM m")
def bucket_sizes(spark, d):
    """Answers for each bucket: the least, the mean and the most."""
    return bucket_means(spark, d).agg(F.min("answers").alias("least"), F.round(F.avg("answers"), 6).alias("mean"), F.max("answers").alias("most"), F.min("n").alias("entities"))


@query("bucket_regression", SQL_GROUPS + ", o AS (SELECT (lo + hi) / 2 AS n, mean AS v FROM m), xs AS (SELECT n, v FROM o QUALIFY row_number() OVER (ORDER BY n DESC, v DESC) > 1), " + bins_sql("xs", 5) + " SELECT (SELECT round(regr_slope(v, n), 6) FROM o) AS slope, (SELECT round(regr_intercept(v, n), 6) FROM o) AS intercept, (SELECT round(corr(ln(edge), mean), 6) FROM bins) AS r")
def bucket_regression(spark, d):
    return S.bucket_regression(bucket_means(spark, d)).select(*[F.round(c, 6).alias(c) for c in ("slope", "intercept", "r")])


#: Fixed value: Student's t of 8 degrees of freedom at 0.05, two-sided.
T8 = 2.306004135


def sweep_sql(t: float) -> str:
    return f"SELECT {t}::DOUBLE AS threshold, r, abs(r) * sqrt(8 / (1 - r * r)) > {T8} AS significant FROM (WITH xs AS (SELECT m.n AS n, acc AS v FROM (SELECT concept_id, count(*) AS n FROM img WHERE prob > {t} GROUP BY 1) m JOIN acc USING (concept_id)), {bins_sql('xs', 12)} SELECT round(corr(ln(edge), mean), 6) AS r FROM bins WHERE bin BETWEEN 1 AND 10)"


@query("threshold_performance", W + X.SQL_IMG + ", " + SQL_ACC + " " + " UNION ALL ".join(map(sweep_sql, X.THRESHOLDS)))
def threshold_performance(spark, d):
    """For each threshold of the image search: how log frequency goes with zero-shot accuracy, over ten inner bins."""
    acc = E.zero_shot(X.embeddings(spark, d)).where("label IS NOT NULL").select(F.col("label").cast("long").alias("concept_id"), "acc")
    n = index.image_postings(X.images(spark, d), X.THRESHOLDS).groupBy("threshold", "concept_id").agg(F.count(F.lit(1)).alias("n")).join(acc, "concept_id")
    bins = S.log_bins(cut(n), "n", "acc", 12, ["threshold"]).where("bin BETWEEN 1 AND 10")  # a row for each threshold and concept
    r = bins.groupBy("threshold").agg(F.round(F.corr(F.log("edge"), F.col("mean")), 6).alias("r"), F.count(F.lit(1)).alias("n"))
    every = spark.range(1).select(F.explode(F.lit(X.THRESHOLDS)).alias("threshold")).join(r, "threshold", "left")
    return S.with_p(every, "r", "n").select("threshold", "r", (F.col("p") < 0.05).alias("significant"))


@query("score_rows", "WITH c AS (SELECT event_id % 11 AS concept, event_id * 2 AS idx FROM events) SELECT concept, count(value) AS n, round(sum(value), 4) AS total, first(value ORDER BY idx) AS head FROM c LEFT JOIN (SELECT event_id AS idx, value FROM events) s USING (idx) GROUP BY concept")
def score_rows(spark, d):
    e = X.table(spark, d, "events")
    concepts = e.select((F.col("event_id") % 11).alias("concept"), (F.col("event_id") * 2).alias("idx"))
    scores = e.select(F.col("event_id").alias("idx"), F.array("value", F.col("value") * 2).alias("scores"))
    met = G.score_rows(concepts, scores).groupBy("concept")
    first = F.min_by("scores", F.when(F.col("scores").isNotNull(), F.col("idx")))
    return met.agg(F.count("scores").alias("n"), F.round(F.sum(F.col("scores")[0]), 4).alias("total"), F.get(first, F.lit(0)).alias("head"))


@query("task_names", "SELECT p_partkey, 'out_' || lower(p_type) AS task FROM part")
def task_names(spark, d):
    files = X.table(spark, d, "part").select("p_partkey", F.concat(F.lit("model_x_out_"), F.lower(F.replace("p_type", F.lit(" "), F.lit("_"))), F.lit(".tar.json")).alias("file"))
    return files.select("p_partkey", G.task_name(F.col("file")).alias("task"))
