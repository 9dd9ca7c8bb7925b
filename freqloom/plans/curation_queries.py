"""Queries over frequency statistics and data set curation."""

from __future__ import annotations

from pyspark.sql import functions as F

from freqloom.functions import stats as S
from freqloom.functions.vectors import known_bits, sign_bits
from freqloom.operators import curate as C
from freqloom.operators import evaluate as E
from freqloom.operators import index

from . import fixtures as X
from .catalog import query
from .search_queries import text_hits
from .string_queries import bins_sql

W = "WITH "


def term_freq(spark, d):
    return index.doc_freq(index.unigram_postings(X.corpus(spark, d)))


SQL_ACC = "ab AS (SELECT vec_id, truth, label, row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 9) DESC, label) AS r FROM sims), acc AS (SELECT truth::BIGINT AS concept_id, avg((truth = label)::INT) * 100 AS acc FROM ab WHERE r = 1 GROUP BY truth)"


@query("freq_vs_accuracy", W + X.SQL_BOTH + ", " + SQL_ACC + ", n AS (SELECT concept_id, concept, count(*) AS n FROM hits GROUP BY ALL) SELECT concept, n, round(acc, 6) AS acc, (SELECT count(*) FROM acc WHERE concept_id NOT IN (SELECT concept_id FROM n)) AS unmatched FROM n JOIN acc USING (concept_id)")
def freq_vs_accuracy(spark, d):
    n = text_hits(spark, d).groupBy("concept_id", "concept").agg(F.count(F.lit(1)).alias("n"))
    acc = E.zero_shot(X.embeddings(spark, d)).where("label IS NOT NULL").select(F.col("label").cast("long").alias("concept_id"), "acc")
    unmatched = acc.join(n, "concept_id", "left_anti").agg(F.count(F.lit(1)).alias("unmatched"))
    return n.join(acc, "concept_id").join(F.broadcast(unmatched)).select("concept", "n", "acc", "unmatched")


SQL_TERM_BINS = W + X.SQL_DF + ", xs AS (SELECT df AS n, length(term) AS v FROM df), " + bins_sql("xs", 12)


def term_bins(spark, d):
    return S.log_bins(term_freq(spark, d).withColumn("v", F.length("term")), "df", "v", 12)


@query("log_bins", SQL_TERM_BINS + " SELECT bin::BIGINT AS bin, round(edge, 6) AS edge, n, round(mean, 6) AS mean, round(std, 6) AS std FROM bins")
def log_bins(spark, d):
    return term_bins(spark, d).select("bin", "n", *[X.r6(F.col(c)).alias(c) for c in ("edge", "mean", "std")])


@query("pearson_bins", SQL_TERM_BINS + " SELECT round(corr(ln(edge), mean), 6) AS r, count(*) AS n FROM bins WHERE bin BETWEEN 1 AND 10 AND n > 0")
def pearson_bins(spark, d):
    return term_bins(spark, d).where("bin BETWEEN 1 AND 10 AND n > 0").agg(F.round(F.corr(F.log("edge"), F.col("mean")), 6).alias("r"), F.count(F.lit(1)).alias("n"))


@query("spearman_counts", "WITH t AS (SELECT DISTINCT doc_id, lang, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents), c AS (SELECT term, count(*) FILTER (WHERE lang = 'en') AS a, count(*) FILTER (WHERE lang = 'fr') AS b FROM t GROUP BY term HAVING a > 0 AND b > 0), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM c) SELECT 'en' AS lang_a, 'fr' AS lang_b, round(corr(ra, rb), 6) AS rho FROM r")
def spearman_counts(spark, d):
    rows = X.table(spark, d, "documents").where(F.col("lang").isin("en", "fr")).select("lang", F.explode(F.array_distinct(index.surface(F.col("text")))).alias("term"))
    n = rows.groupBy("term").agg(*[F.count(F.when(F.col("lang") == x, 1)).alias(c) for x, c in (("en", "a"), ("fr", "b"))]).where("a > 0 AND b > 0")
    ra, rb = S.rank_by_value(n, "term", "a", "ra"), S.rank_by_value(n, "term", "b", "rb")
    return ra.join(rb, "term").agg(F.round(F.corr("ra", "rb"), 6).alias("rho")).select(F.lit("en").alias("lang_a"), F.lit("fr").alias("lang_b"), "rho")


@query("piecewise_ols", "WITH m AS (SELECT user_id, avg(value) FILTER (WHERE event_type = 'view') AS x, avg(value) FILTER (WHERE event_type = 'click') AS y FROM events WHERE user_id <> 7 GROUP BY 1), s AS (SELECT CASE WHEN x < 50 THEN 'low' WHEN x > 50 THEN 'high' END AS segment, x, y FROM m WHERE x <> 50 AND y IS NOT NULL) SELECT segment, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept FROM s GROUP BY segment")
def piecewise_ols(spark, d):
    e = X.table(spark, d, "events").where("user_id <> 7")
    m = e.groupBy("user_id").agg(*[F.avg(F.when(F.col("event_type") == t, F.col("value"))).alias(c) for t, c in (("view", "x"), ("click", "y"))])
    s = m.where("x <> 50 AND y IS NOT NULL").withColumn("segment", F.when(F.col("x") < 50, "low").when(F.col("x") > 50, "high"))
    return s.groupBy("segment").agg(F.round(F.regr_slope("y", "x"), 6).alias("slope"), F.round(F.regr_intercept("y", "x"), 6).alias("intercept"))


@query("long_tail_curve", W + X.SQL_DF + ", r AS (SELECT df, row_number() OVER (ORDER BY df DESC) AS rank FROM df) SELECT min(rank) AS rank, round(df / (SELECT max(df) FROM df), 6) AS norm_freq, count(*) AS terms FROM r GROUP BY df")
def long_tail_curve(spark, d):
    return C.long_tail(term_freq(spark, d)).withColumn("norm_freq", X.r6(F.col("norm_freq")))


SQL_BUCKETS = """, runs AS (SELECT df AS v, count(*) AS c, row_number() OVER (ORDER BY df DESC) AS i FROM df GROUP BY df),
f(i, held, lo, hi, made) AS (
  SELECT 0::BIGINT, 0::BIGINT, 9223372036854775807, 0::BIGINT, []::STRUCT(n BIGINT, lo BIGINT, hi BIGINT)[]
  UNION ALL
  SELECT i, total % 1000, CASE WHEN total % 1000 = 0 THEN 9223372036854775807 ELSE v END,
         CASE WHEN total % 1000 = 0 THEN 0 WHEN total >= 1000 THEN v ELSE greatest(top, v) END,
         made || CASE WHEN ends THEN [{'n': held, 'lo': lo, 'hi': hi}] ELSE [] END
              || list_transform(range(total // 1000), lambda k: {'n': 1000::BIGINT, 'lo': v, 'hi': CASE WHEN k = 0 THEN greatest(top, v) ELSE v END})
  FROM (SELECT runs.i, v, held, lo, hi, made, v < lo AND held >= 100 AS ends, CASE WHEN v < lo AND held >= 100 THEN 0 ELSE held END + c AS total, CASE WHEN v < lo AND held >= 100 THEN 0 ELSE hi END AS top FROM f JOIN runs ON runs.i = f.i + 1)
)
SELECT (k - 1)::BIGINT AS bucket, b.n AS n, b.lo AS lo, b.hi AS hi FROM (SELECT generate_subscripts(made, 1) AS k, unnest(made) AS b FROM f WHERE i = (SELECT max(i) FROM runs))"""


@query("quantile_buckets", "WITH RECURSIVE " + X.SQL_DF + SQL_BUCKETS)
def quantile_buckets(spark, d):
    return C.quantile_buckets(term_freq(spark, d))


@query("tail_concepts", W + X.SQL_DF + " SELECT term, df FROM df ORDER BY df, term LIMIT 290")
def tail_concepts(spark, d):
    return C.tail(term_freq(spark, d), 290)


SQL_PAIRS = "WITH s AS (SELECT min(vec_id) AS vec_id, label, list_transform(embedding, lambda x: (x > 0)::INT) AS b FROM embeddings GROUP BY label, 3), p AS (SELECT x.label, x.vec_id AS a, y.vec_id AS b, list_sum(list_transform(list_zip(x.b, y.b), lambda t: (t[1] <> t[2])::INT))::BIGINT AS dist FROM s x JOIN s y ON x.label = y.label AND x.vec_id < y.vec_id)"


def hashes(spark, d):
    return X.embeddings(spark, d).select("vec_id", F.col("label").cast("long").alias("label"), sign_bits(F.col("embedding")).alias("bits"))


#: As SQL_PAIRS, of all vectors instead of one for each hash.
SQL_ALL_PAIRS = SQL_PAIRS.replace("min(vec_id) AS vec_id", "vec_id").replace(" GROUP BY label, 3", "")


@query("hamming_dups", SQL_ALL_PAIRS + " SELECT label::BIGINT AS label, a, b, dist FROM p WHERE dist <= 22")
def hamming_dups(spark, d):
    """Every pair of vectors, those of equal signs too; signs are compared where both vectors have an element."""
    v = F.concat("embedding", F.array_repeat(F.lit(None).cast("float"), 64 - F.size("embedding")))
    rows = X.embeddings(spark, d).select("vec_id", F.col("label").cast("long").alias("label"), sign_bits(v).alias("bits"), known_bits(v).alias("known"))
    return C.row_pairs(rows, "label", "vec_id", "bits", radius=22, known="known")


@query("hamming_dups_banded", SQL_PAIRS + " SELECT label::BIGINT AS label, a, b, dist FROM p WHERE dist <= 10")
def hamming_dups_banded(spark, d):
    return C.hash_pairs(hashes(spark, d), "label", "vec_id", "bits")


SQL_CLASSES = ", near AS (SELECT * FROM p WHERE dist <= 22), k AS (SELECT x, count(*) AS links FROM (SELECT a AS x FROM near UNION ALL SELECT b FROM near) GROUP BY x), e AS (SELECT vec_id, label, list_transform(embedding, lambda x: (x > 0)::INT) AS b FROM embeddings) SELECT e.label::BIGINT AS label, e.vec_id, s.vec_id AS rep, coalesce(links, 0) AS links FROM e JOIN s ON e.label = s.label AND e.b = s.b LEFT JOIN k ON s.vec_id = k.x"


@query("hamming_classes", SQL_PAIRS + SQL_CLASSES)
def hamming_classes(spark, d):
    """Every vector with its class of equal hashes and that class's number of neighbours."""
    rows = hashes(spark, d)
    return C.classes(rows, C.hash_pairs(rows, "label", "vec_id", "bits", radius=22), "label", "vec_id", "bits")


SQL_GREEDY = SQL_PAIRS.replace("WITH ", "WITH RECURSIVE ", 1) + """, near AS (SELECT a, b FROM p WHERE dist <= 22),
nodes AS (SELECT x, row_number() OVER (ORDER BY x) AS i, (SELECT coalesce(list(a), []) FROM near WHERE b = x) AS before FROM (SELECT a AS x FROM near UNION SELECT b FROM near)),
g(i, kept, gone) AS (
  SELECT 0::BIGINT, []::BIGINT[], []::BIGINT[]
  UNION ALL
  SELECT nodes.i, CASE WHEN list_has_any(kept, before) THEN kept ELSE list_append(kept, x) END, CASE WHEN list_has_any(kept, before) THEN list_append(gone, x) ELSE gone END FROM g JOIN nodes ON nodes.i = g.i + 1
), removed AS (SELECT unnest(gone) AS vec_id FROM g WHERE i = (SELECT count(*) FROM nodes))
SELECT label::BIGINT AS label, count(*) AS survivors FROM s WHERE vec_id NOT IN (SELECT vec_id FROM removed) GROUP BY label"""


@query("greedy_dedup", SQL_GREEDY)
def greedy_dedup(spark, d):
    rows = hashes(spark, d)
    kept = C.greedy_survivors(C.representatives(rows, "label", "vec_id", "bits"), C.hash_pairs(rows, "label", "vec_id", "bits", radius=22), "label", "vec_id")
    return kept.groupBy("label").agg(F.count(F.lit(1)).alias("survivors"))


MD5 = "md5(vec_id::VARCHAR || '-7')"


def random_order():
    return [F.md5(F.concat(F.col("vec_id").cast("string"), F.lit("-7"))), "vec_id"]


@query("class_balance", f"WITH c AS (SELECT label, vec_id, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY {MD5}, vec_id) AS r FROM embeddings) SELECT label::BIGINT AS label, vec_id FROM c WHERE n > 45 AND r <= 45")
def class_balance(spark, d):
    rows = X.embeddings(spark, d).select(F.col("label").cast("long").alias("label"), "vec_id")
    return C.balance(rows, "label", random_order(), 45, 45)


@query("k_shot_sample", f"SELECT label::BIGINT AS label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY {MD5}, vec_id) AS r FROM embeddings) WHERE r <= 5")
def k_shot_sample(spark, d):
    return C.k_shot(X.embeddings(spark, d).select(F.col("label").cast("long").alias("label"), "vec_id"), "label", random_order(), 5)
