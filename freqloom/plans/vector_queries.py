"""Queries over embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from freqloom.functions.vectors import dot
from freqloom.operators import evaluate as E
from freqloom.operators import neighbours as N

from . import fixtures as X
from .catalog import query

W = "WITH "


@query("class_prototypes", W + X.SQL_PROTO + " SELECT label::BIGINT AS label, pos::BIGINT AS pos, round(value, 6) AS value FROM proto")
def class_prototypes(spark, d):
    return E.prototypes(X.embeddings(spark, d)).select(F.col("label").cast("long").alias("label"), F.col("pos").cast("long").alias("pos"), X.r6(F.col("value")).alias("value"))


@query("zero_shot_accuracy", W + X.SQL_SIMS + ", b AS (SELECT vec_id, truth, label, row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 9) DESC, label) AS r FROM sims) SELECT truth::BIGINT AS label, round(avg((truth = label)::INT) * 100, 6) AS acc FROM b WHERE r = 1 GROUP BY ROLLUP (truth)")
def zero_shot_accuracy(spark, d):
    return E.zero_shot(X.embeddings(spark, d)).select(F.col("label").cast("long").alias("label"), "acc")


SQL_TOP = "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS q, c.vec_id AS cand, round(list_dot_product(q.e, c.e), 9) AS sim FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, cand) AS rank FROM s) SELECT q, rank, cand, round(sim, 6) AS sim FROM r WHERE rank <= 10"


@query("cosine_topk", SQL_TOP)
def cosine_topk(spark, d):
    v = X.embeddings(spark, d)
    return E.top_k(v.where("vec_id % 50 = 0"), v, 10)


@query("pruned_topk", SQL_TOP)
def pruned_topk(spark, d):
    """The same by cells of vectors."""
    v = X.embeddings(spark, d)
    return N.top_k(v.where("vec_id % 50 = 0"), N.cells(v), 10)


SQL_RANKS = """WITH v AS (SELECT vec_id, vec_id // 6 AS g, vec_id % 6 AS m, label, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT t.vec_id AS t, i.vec_id AS i, t.g = i.g AS own, t.label AS tl, i.label AS il, round(list_dot_product(t.e, i.e), 9) AS sim FROM v t JOIN v i ON t.m > 0 AND i.m = 0),
a AS (SELECT t, tl, own, row_number() OVER (PARTITION BY t ORDER BY sim DESC, i) AS r FROM s),
b AS (SELECT i, il, own, row_number() OVER (PARTITION BY i ORDER BY sim DESC, t) AS r FROM s),
ranks AS (SELECT 'text_to_image' AS direction, tl::BIGINT AS concept, min(r) AS rank FROM a WHERE own GROUP BY t, tl UNION ALL SELECT 'image_to_text', il::BIGINT, min(r) FROM b WHERE own GROUP BY i, il),
k AS (SELECT direction, concept, rank, unnest([1, 5, 10]) AS k FROM ranks)"""


def ranks(spark, d, pruned=False):
    v = X.embeddings(spark, d).select("vec_id", F.floor(F.col("vec_id") / 6).alias("own_id"), (F.col("vec_id") % 6).alias("m"), F.col("label").cast("long").alias("concept"), F.col("embedding").alias("v"))
    texts, images = v.where("m > 0"), v.where("m = 0")
    found = []
    for name, a, b in (("text_to_image", texts, images), ("image_to_text", images, texts)):
        asked, held = a.select(F.col("vec_id").alias("query_id"), "own_id", "v"), b.select(F.col("vec_id").alias("cand_id"), "own_id", "v")
        r = N.true_ranks(asked, held, N.cells(held, "cand_id", "v")) if pruned else E.true_ranks(asked, held)
        found.append(r.join(a.select(F.col("vec_id").alias("query_id"), "concept"), "query_id").select(F.lit(name).alias("direction"), "concept", "rank"))
    return found[0].unionByName(found[1])


SQL_RECALL = SQL_RANKS + " SELECT direction, k::BIGINT AS k, round(avg((rank <= k)::INT) * 100, 6) AS recall FROM k GROUP BY direction, k"


@query("retrieval_recall", SQL_RECALL)
def retrieval_recall(spark, d):
    return E.recall(ranks(spark, d), by=["direction"])


@query("pruned_recall", SQL_RECALL)
def pruned_recall(spark, d):
    """The same by cells of candidates."""
    return E.recall(ranks(spark, d, pruned=True), by=["direction"])


@query("retrieval_conceptwise", SQL_RANKS + " SELECT direction, k::BIGINT AS k, concept, round(avg((rank <= k)::INT) * 100, 6) AS recall FROM k GROUP BY direction, k, concept")
def retrieval_conceptwise(spark, d):
    return E.recall(ranks(spark, d), by=["direction", "concept"])


@query("softmax_reweight", W + X.SQL_SIMS + " SELECT vec_id, label::BIGINT AS label, round(exp(sim) / sum(exp(sim)) OVER (PARTITION BY vec_id), 6) AS weight FROM sims")
def softmax_reweight(spark, d):
    v = X.embeddings(spark, d)
    return E.softmax_weights(E.class_similarity(v, E.prototype_arrays(v), "vec_id"), "vec_id").select("vec_id", F.col("label").cast("long").alias("label"), X.r6(F.col("weight")).alias("weight"))


@query("clip_batch_accuracy", "WITH v AS (SELECT vec_id // 2 AS p, vec_id % 2 AS m, vec_id // 16 AS b, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT i.b, i.p AS p, t.p AS c, row_number() OVER (PARTITION BY i.p ORDER BY round(list_dot_product(i.e, t.e), 9) DESC, t.p) AS r FROM v i JOIN v t ON i.b = t.b AND i.m = 0 AND t.m = 1) SELECT b AS batch, round(avg((p = c)::INT) * 100, 6) AS acc FROM s WHERE r = 1 GROUP BY b")
def clip_batch_accuracy(spark, d):
    v = X.embeddings(spark, d).select(F.floor(F.col("vec_id") / 2).alias("p"), (F.col("vec_id") % 2).alias("m"), F.floor(F.col("vec_id") / 16).alias("batch"), F.col("embedding").alias("e"))
    i, t = v.where("m = 0").alias("i"), v.where("m = 1").alias("t")
    best = i.join(t, F.col("i.batch") == F.col("t.batch")).groupBy("i.batch", "i.p").agg(F.max(F.struct(F.round(dot(F.col("i.e"), F.col("t.e")), 9).alias("s"), (-F.col("t.p")).alias("c"))).alias("m"))
    return best.groupBy("batch").agg(F.round(F.avg((F.col("p") == -F.col("m.c")).cast("double")) * 100, 6).alias("acc"))


SQL_PAIRED = "WITH v AS (SELECT vec_id // 2 AS p, vec_id % 2 AS m, vec_id // 16 AS b, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT i.b, i.p AS ip, t.p AS tp, 10 * list_dot_product(i.e, t.e) AS s FROM v i JOIN v t ON i.b = t.b AND i.m = 0 AND t.m = 1), x AS (SELECT b, ln(sum(exp(s))) - sum(s) FILTER (WHERE ip = tp) AS l FROM s GROUP BY b, ip HAVING count(*) FILTER (WHERE ip = tp) > 0 UNION ALL SELECT b, ln(sum(exp(s))) - sum(s) FILTER (WHERE ip = tp) FROM s GROUP BY b, tp HAVING count(*) FILTER (WHERE ip = tp) > 0)"


@query("clip_batch_loss", SQL_PAIRED + " SELECT b AS batch, round(avg(l), 6) AS loss FROM x GROUP BY b")
def clip_batch_loss(spark, d):
    """Mean over both directions of the cross entropy of each pair among its batch."""
    v = X.embeddings(spark, d).select(F.floor(F.col("vec_id") / 2).alias("p"), (F.col("vec_id") % 2).alias("m"), F.floor(F.col("vec_id") / 16).alias("batch"), F.col("embedding").alias("e"))
    i, t = v.where("m = 0").select("batch", F.col("p").alias("ip"), F.col("e").alias("ie")), v.where("m = 1").select("batch", F.col("p").alias("tp"), F.col("e").alias("te"))
    return E.contrastive_loss(i.join(t, "batch").select("batch", "ip", "tp", (10 * dot(F.col("ie"), F.col("te"))).alias("s"))).withColumn("loss", X.r6(F.col("loss")))


@query("mean_average_precision", W + X.SQL_SIMS + ", p AS (SELECT vec_id, label, (truth = label)::INT AS hit, round(1 / (1 + exp(-6 * sim)), 6) AS prob FROM sims), r AS (SELECT label, hit, row_number() OVER w AS rank, sum(hit) OVER (w ROWS UNBOUNDED PRECEDING) AS cum FROM p WINDOW w AS (PARTITION BY label ORDER BY prob DESC, vec_id DESC)) SELECT label::BIGINT AS label, round(sum(hit * cum / rank) / (sum(hit) + 1e-8), 6) AS ap FROM r GROUP BY label")
def mean_average_precision(spark, d):
    rows = tagged(spark, d).select("label", F.col("sample_id").alias("id"), F.col("prob").alias("score"), "hit")
    return E.average_precision(rows, "label").select("label", X.r6(F.col("ap")).alias("ap"))


@query("precision_recall", W + X.SQL_IMG + ", j AS (SELECT concept_id AS label, (prob > 0.6)::INT AS said, (label = concept_id)::INT AS hit FROM img JOIN embeddings ON sample_id = vec_id) SELECT label, round(sum(said * hit) / (sum(said) + 1e-9), 6) AS p, round(sum(said * hit) / (sum(hit) + 1e-9), 6) AS r FROM j GROUP BY label")
def precision_recall(spark, d):
    rows = tagged(spark, d).select("label", (F.col("prob") > 0.6).cast("int").alias("said"), "hit")
    return E.precision_recall(rows, "label").select("label", X.r6(F.col("p")).alias("p"), X.r6(F.col("r")).alias("r"))


def tagged(spark, d):
    """(sample_id, label, prob, hit): tag probabilities with whether the tag is the sample's label."""
    v = X.embeddings(spark, d)
    sims = E.class_similarity(v, E.prototype_arrays(v), "vec_id")
    prob = F.round(1 / (1 + F.exp(-6 * F.col("sim"))), 6)
    return sims.select(F.col("vec_id").alias("sample_id"), F.col("label").cast("long").alias("label"), prob.alias("prob"), (F.col("truth") == F.col("label")).cast("int").alias("hit"))
