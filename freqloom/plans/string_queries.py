"""Queries over names, prompts and scores of generated images."""

from __future__ import annotations

from pyspark.sql import functions as F

from freqloom.functions import stats as S
from freqloom.functions import text as T
from freqloom.operators import automaton, prompts
from freqloom.operators import generated as G

from . import fixtures as X
from .catalog import query
from .search_queries import text_hits

W = "WITH "


def rows_of(spark, rows, columns):
    """A literal table: an inline array of structs."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(r, columns)]) for r in rows])))


@query("case_variants", W + X.SQL_NAMES + r""", w AS (SELECT concept_id, concept, list_filter(regexp_split_to_array(concept, '[_\s]+'), lambda x: x <> '') AS w FROM concepts),
v AS (SELECT concept_id, concept, list_transform(w, lambda x: [lower(x), upper(x[1]) || lower(x[2:])]) AS v FROM w)
SELECT DISTINCT concept_id, concept, array_to_string(list_filter([a, b, c], lambda x: x IS NOT NULL), '_') AS variant FROM v, LATERAL (SELECT unnest(v[1]) AS a), LATERAL (SELECT unnest(coalesce(v[2], [NULL])) AS b), LATERAL (SELECT unnest(coalesce(v[3], [NULL])) AS c)""")
def case_variants(spark, d):
    return X.names(spark, d).select("concept_id", "concept", F.explode(T.case_variants(F.col("concept"))).alias("variant")).distinct()


@query("key_normalize", W + X.SQL_NAMES + " SELECT concept, lower(replace(concept, '_', ' ')) AS key FROM concepts")
def key_normalize(spark, d):
    return X.names(spark, d).select("concept", T.concept_key(F.col("concept")).alias("key"))


RENAMED = "CASE WHEN class = 'plane' THEN 'airplane' ELSE regexp_replace(regexp_replace(regexp_replace(class, '^[0-9]+\\.', ''), '-101$', ''), '_(indoor|outdoor)$', '') END"


@query("class_rename", f"WITH c AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'plane' WHEN 1 THEN lpad((p_partkey % 1000)::VARCHAR, 3, '0') || '.' || replace(p_name, ' ', '_') WHEN 2 THEN p_name || '-101' WHEN 3 THEN p_name || '_outdoor' WHEN 4 THEN p_name || '_indoor' ELSE p_name END AS class FROM part) SELECT p_partkey, class, {RENAMED} AS renamed FROM c")
def class_rename(spark, d):
    """Class names in the spellings of several data sets, brought to one."""
    k, name = F.col("p_partkey"), F.col("p_name")
    spelled = F.when(k % 6 == 0, "plane").when(k % 6 == 1, F.concat(F.lpad((k % 1000).cast("string"), 3, "0"), F.lit("."), F.replace(name, F.lit(" "), F.lit("_")))).when(k % 6 == 2, F.concat(name, F.lit("-101"))).when(k % 6 == 3, F.concat(name, F.lit("_outdoor"))).when(k % 6 == 4, F.concat(name, F.lit("_indoor"))).otherwise(name)
    return X.table(spark, d, "part").select("p_partkey", spelled.alias("class")).withColumn("renamed", T.class_name(F.col("class")))


#: Prompt modes and their templates.
TEMPLATES = [("class", "{c}"), ("simple", "A photo of a {c}."), ("ensemble", "a photo of a {c}."), ("ensemble", "a drawing of the {c}."), ("ensemble", "a close-up photo of one {c}.")]


@query("prompt_expand", W + X.SQL_NAMES + f" SELECT concept, mode, replace(template, '{{c}}', concept) AS prompt FROM concepts, {X.values(TEMPLATES, 'mode, template')}")
def prompt_expand(spark, d):
    return prompts.expand(X.names(spark, d), rows_of(spark, TEMPLATES, ["mode", "template"]))


LINES = [prompts.SEED, *[q for q in prompts.QUESTIONS for _ in range(prompts.ANSWERS)]]


@query("description_requests", W + X.SQL_NAMES + f" SELECT concept, place::BIGINT AS place, replace(template, '{{c}}', concept) AS line FROM concepts, {X.values(list(enumerate(LINES)), 'place, template')} WHERE concept_id % 3 = 0 AND concept NOT IN (SELECT concept FROM concepts WHERE concept_id < 5)")
def description_requests(spark, d):
    c = X.names(spark, d)
    return prompts.description_requests(c.where("concept_id % 3 = 0"), c.where("concept_id < 5"))


#: Texts made of a class name.
LABEL_TEMPLATES = [("set", "There is {article} {c} in the scene."), ("set", "a photo of the {c}."), ("set", "the {c} in a photo.")]


@query("label_texts", W + X.SQL_NAMES + f", t AS (SELECT concept AS c, mode, template FROM (SELECT regexp_replace(lower(replace(replace(concept, '_', ' '), '/', ' or ')), '\\.+$', '') AS concept FROM concepts), {X.values(LABEL_TEMPLATES, 'mode, template')}), p AS (SELECT c AS concept, mode, replace(replace(template, '{{article}}', CASE WHEN regexp_matches(c, '^[aeiou]') THEN 'an' ELSE 'a' END), '{{c}}', c) AS p FROM t) SELECT concept, mode, CASE WHEN p LIKE 'a%' OR p LIKE 'the%' THEN 'This is ' || p ELSE p END AS prompt FROM p")
def label_texts(spark, d):
    return prompts.label_texts(X.names(spark, d), rows_of(spark, LABEL_TEMPLATES, ["mode", "template"]))


@query("prompt_article", W + X.SQL_NAMES + r", p AS (SELECT concept, regexp_replace(lower(replace(replace(concept, '_', ' '), '/', ' or ')), '\.+$', '') AS n FROM concepts) SELECT concept, 'This is ' || CASE WHEN regexp_matches(n, '^[aeiou]') THEN 'an ' ELSE 'a ' END || n || '.' AS prompt FROM p")
def prompt_article(spark, d):
    return X.names(spark, d).select("concept", T.with_article(F.col("concept")).alias("prompt"))


@query("pre_caption", r"""SELECT doc_id, sha256(array_to_string(w[1:50], ' ')) AS cleaned, len(w[1:50])::BIGINT AS words FROM (SELECT doc_id, string_split(trim(rtrim(regexp_replace(regexp_replace(lower(text), '[.!"()*#:;~]', ' ', 'g'), '\s{2,}', ' ', 'g'), chr(10)), ' '), ' ') AS w FROM documents)""")
def pre_caption(spark, d):
    c = T.caption(F.col("text"))
    return X.table(spark, d, "documents").select("doc_id", F.sha2(c, 256).alias("cleaned"), F.size(F.split(c, " ")).cast("long").alias("words"))


@query("pre_question", r"""SELECT doc_id, sha256(array_to_string(w[1:50], ' ')) AS cleaned, len(w[1:50])::BIGINT AS words FROM (SELECT doc_id, string_split(rtrim(regexp_replace(lower(text), '[.!"()*#:;~]', '', 'g'), ' '), ' ') AS w FROM documents)""")
def pre_question(spark, d):
    c = T.question(F.col("text"))
    return X.table(spark, d, "documents").select("doc_id", F.sha2(c, 256).alias("cleaned"), F.size(F.split(c, " ")).cast("long").alias("words"))


PLAIN_WORDS = "replace(concept, '_', ' ')"


@query("prompt_contains", W + X.SQL_CONCEPTS + f", p AS (SELECT item_id, ' ' || regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g') || ' ' AS p FROM benchmark) SELECT concept, item_id FROM p, concepts WHERE contains(p, ' ' || lower({PLAIN_WORDS}) || ' ') OR contains(p, ' ' || lower({PLAIN_WORDS}) || 's')")
def prompt_contains(spark, d):
    return automaton.mentions(X.table(spark, d, "benchmark"), X.concepts(spark), "item_id")


@query("prompt_exact", W + X.SQL_CONCEPTS + " SELECT concept, vec_id FROM (SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN c WHEN 1 THEN c || ' ' ELSE 'a ' || c END AS prompt FROM (SELECT vec_id, (SELECT list(concept ORDER BY concept_id) FROM concepts)[vec_id % 20 + 1] AS c FROM embeddings)) JOIN concepts ON prompt = concept")
def prompt_exact(spark, d):
    """Prompts that are a concept's name and nothing else."""
    name = F.element_at(F.lit(X.CONCEPTS), (F.col("vec_id") % 20 + 1).cast("int"))
    kind = F.col("vec_id") % 3
    prompt = F.when(kind == 0, name).when(kind == 1, F.concat(name, F.lit(" "))).otherwise(F.concat(F.lit("a "), name))
    rows = X.embeddings(spark, d).select("vec_id", prompt.alias("concept"))
    return rows.join(F.broadcast(X.concepts(spark)), "concept").select("concept", "vec_id")


@query("path_concept", "WITH p AS (SELECT 'refs/' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') || '.' || replace(p_name, ' ', '_') || '/' || p_partkey || '.png' AS path FROM part) SELECT path, replace(split_part(split_part(path, '/', -2), '.', 2), '_', ' ') AS concept FROM p")
def path_concept(spark, d):
    """The concept in the folder of a reference image."""
    k = F.col("p_partkey")
    path = F.concat(F.lit("refs/"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit("."), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("/"), k.cast("string"), F.lit(".png"))
    return X.table(spark, d, "part").select(path.alias("path")).withColumn("concept", T.path_concept(F.col("path")))


@query("tag_join", W + X.SQL_CONCEPTS + ", " + X.SQL_IMG + " SELECT sample_id, string_agg(concept, ' | ' ORDER BY concept_id) AS tags FROM img JOIN concepts USING (concept_id) WHERE prob > 0.6 GROUP BY sample_id")
def tag_join(spark, d):
    rows = X.images(spark, d).where("prob > 0.6").join(F.broadcast(X.concepts(spark)), "concept_id")
    tags = rows.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("concept_id", "concept"))).alias("t"))
    return tags.select("sample_id", F.array_join(F.transform("t", lambda x: x["concept"]), " | ").alias("tags"))


#: Backbone, pretraining set and checkpoint of models.
MODELS = [("RN50", "cc3m", "rn50_cc3m.pt"), ("RN50", "cc12m", "rn50_cc12m.pt"), ("RN101", "yfcc15m", "rn101_yfcc15m.pt"), ("ViT-B-32", "laion400m", "vitb32_laion400m.pt"), ("ViT-B-16", "laion400m", "vitb16_laion400m.pt"), ("ViT-L-14", "laion400m", "vitl14_laion400m.pt")]
KEYS = [f"backbone_{b}_pretrained_{p}" for b, p, _ in MODELS]


EVENT_KEYS = f"ev AS (SELECT event_id, ({KEYS!r})[event_id % 6 + 1] AS key FROM events)"


def event_keys(spark, d):
    """(event_id, key): a model's key for each event."""
    return X.table(spark, d, "events").select("event_id", F.element_at(F.lit(KEYS), (F.col("event_id") % len(KEYS) + 1).cast("int")).alias("key"))


@query("model_key_parse", W + EVENT_KEYS + " SELECT event_id, key, regexp_extract(key, '^backbone_(.+)_pretrained_(.+)$', 1) AS backbone, regexp_extract(key, '^backbone_(.+)_pretrained_(.+)$', 2) AS pretrained FROM ev")
def model_key_parse(spark, d):
    return event_keys(spark, d).select("event_id", "key", *[F.regexp_extract("key", "^backbone_(.+)_pretrained_(.+)$", k).alias(c) for k, c in ((1, "backbone"), (2, "pretrained"))])


@query("label_lookup", "SELECT n_name AS name, n_nationkey::BIGINT AS idx, r_name AS class FROM nation JOIN region ON n_regionkey = r_regionkey")
def label_lookup(spark, d):
    n, r = X.table(spark, d, "nation"), X.table(spark, d, "region")
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("idx"), F.col("r_name").alias("class"))


def checkpoint_of(backbone: str, pretrained: str) -> str:
    """The checkpoint of a model; an unknown pair raises."""
    for b, p, c in MODELS:
        if (b, p) == (backbone, pretrained):
            return c
    raise ValueError(f"no model {backbone} with {pretrained}")


@query("model_registry", W + EVENT_KEYS + f" SELECT backbone, pretrained, checkpoint, count(*) AS n FROM ev JOIN {X.values(MODELS, 'backbone, pretrained, checkpoint')} ON key = 'backbone_' || backbone || '_pretrained_' || pretrained GROUP BY ALL")
def model_registry(spark, d):
    """How many events each registered model has."""
    parts = model_key_parse(spark, d).groupBy("backbone", "pretrained").agg(F.count(F.lit(1)).alias("n"))
    return parts.join(F.broadcast(rows_of(spark, MODELS, ["backbone", "pretrained", "checkpoint"])), ["backbone", "pretrained"]).select("backbone", "pretrained", "checkpoint", "n")


@query("model_pick", W + EVENT_KEYS + " SELECT backbone, min_by(key, event_id) AS key, count(*) AS n FROM ev JOIN (VALUES ('RN'), ('ViT')) k(backbone) ON contains(key, backbone) AND contains(key, '1') GROUP BY backbone")
def model_pick(spark, d):
    """The first key of each backbone family with a given part."""
    fits = F.filter(F.lit(["RN", "ViT"]), lambda b: F.contains(F.col("key"), b))
    keys = event_keys(spark, d).where(F.contains("key", F.lit("1"))).select("event_id", "key", F.explode(fits).alias("backbone"))
    return keys.groupBy("backbone").agg(F.min_by("key", "event_id").alias("key"), F.count(F.lit(1)).alias("n"))


@query("t2i_parse", "SELECT e.item_id AS instance_id, e.metric, e.k::BIGINT AS value FROM (SELECT item_id, metric, k FROM benchmark LEFT JOIN (SELECT event_id, event_type AS metric, json_extract_string(props, '$.k')::BIGINT AS k FROM events) x ON item_id * 3 = event_id) e")
def t2i_parse(spark, d):
    prompts = X.table(spark, d, "benchmark").select("item_id", (F.col("item_id") * 3).alias("event_id"))
    stats = X.table(spark, d, "events").select("event_id", F.col("event_type").alias("metric"), F.get_json_object("props", "$.k").cast("long").alias("value"))
    return G.attach(prompts, stats, "event_id").select(F.col("item_id").alias("instance_id"), "metric", "value")


@query("t2i_stats", "SELECT 'e' || event_id AS instance_id, 0::BIGINT AS pos, event_type AS metric, value AS sum, value / 2 AS mean FROM events")
def t2i_stats(spark, d):
    """Statistics read from JSON in which each event stands twice, the second time without any."""
    one = F.struct(F.struct(F.col("event_type").alias("name")).alias("name"), F.col("value").alias("sum"), (F.col("value") / 2).alias("mean"))
    name = F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("instance_id")
    made = F.to_json(F.array(F.struct(name, F.array(one).alias("stats")), F.struct(name, F.filter(F.array(one), lambda x: F.lit(False)).alias("stats"))))
    return G.parse_stats(X.table(spark, d, "events").select(made.alias("j")), "j").withColumn("pos", F.col("pos").cast("long"))


@query("metric_range", "SELECT event_type AS metric, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY 1")
def metric_range(spark, d):
    return G.metric_range(X.table(spark, d, "events").select("event_id", F.col("event_type").alias("metric")), "event_id")


@query("t2i_aggregate", W + X.SQL_SCORES + " SELECT model, metric, concept_id, round(coalesce(sum(score) / nullif(count(score), 0), 0), 6) AS mean, count(score) AS n FROM scores GROUP BY GROUPING SETS ((model, metric, concept_id), (model, metric))")
def t2i_aggregate(spark, d):
    return G.aggregate(X.scores(spark, d), ["model", "metric"], "concept_id", "score").withColumn("mean", X.r6(F.col("mean")))


@query("t2i_combine", W + X.SQL_SCORES + ", m AS (SELECT model, metric, concept_id % 3 AS dataset, avg(score) AS mean, count(score) AS n FROM scores GROUP BY ALL) SELECT model, metric, round(coalesce(sum(mean * n) / nullif(sum(n), 0), 0), 6) AS mean FROM m GROUP BY model, metric")
def t2i_combine(spark, d):
    means = X.scores(spark, d).groupBy("model", "metric", (F.col("concept_id") % 3).alias("dataset")).agg(F.avg("score").alias("mean"), F.count("score").alias("n"))
    return G.combine(means, ["model", "metric"]).withColumn("mean", X.r6(F.col("mean")))


def bins_sql(x: str, nb: int) -> str:
    """SQL of log_bins over a CTE ``x`` with columns n and v."""
    return f"""l AS (SELECT ln(greatest(n, 1)::DOUBLE) AS x, v::DOUBLE AS v FROM {x}), mm AS (SELECT min(x) AS lo, max(x) AS hi FROM l),
edges AS (SELECT i AS bin, CASE WHEN i = {nb - 1} THEN hi ELSE lo + i * (hi - lo) / {nb - 1} END AS e FROM mm, range({nb}) t(i)),
p AS (SELECT (SELECT count(*) FROM edges WHERE e < x) AS bin, v FROM l), g AS (SELECT bin, count(*) AS n, avg(v) AS mean, stddev_pop(v) AS std FROM p GROUP BY bin),
bins AS (SELECT edges.bin AS bin, exp(e) AS edge, coalesce(n, 0) AS n, coalesce(mean, 0) AS mean, coalesce(std, 0) AS std FROM edges LEFT JOIN g ON edges.bin = g.bin)"""


@query("t2i_bins", W + X.SQL_SEARCH + ", " + X.SQL_SCORES + ", cm AS (SELECT concept_id, avg(score) AS v FROM scores GROUP BY 1 HAVING count(score) > 5), cn AS (SELECT concept_id, count(*) AS n FROM hits GROUP BY 1), xs AS (SELECT n, v FROM cm JOIN cn USING (concept_id)), " + bins_sql("xs", 7) + " SELECT bin::BIGINT AS bin, n, round(mean, 6) AS mean, round(std, 6) AS std FROM bins")
def t2i_bins(spark, d):
    means = G.concept_means(X.scores(spark, d), "concept_id", "score")
    n = text_hits(spark, d).groupBy("concept_id").agg(F.count(F.lit(1)).alias("n"))
    out = S.log_bins(n.join(means, "concept_id"), "n", "mean", 7)
    return out.select("bin", "n", X.r6(F.col("mean")).alias("mean"), X.r6(F.col("std")).alias("std"))
