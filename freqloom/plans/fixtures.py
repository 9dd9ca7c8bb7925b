"""Stand-ins for corpora, images and models, built from the test tables; each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freqloom.functions.text import lemma_sql
from freqloom.operators import evaluate

#: The query concepts, ids from 0.
CONCEPTS = ["that", "with from", "this_that", "tion", "that with from", "from zzqx", "ering", "thing", "ouch", "und", "der die", "les des", "las_los", "The That", "heed", "that zzqx with", "en la", "zzqx", "ring", "into"]
THRESHOLDS = [0.5, 0.55, 0.6, 0.65, 0.7]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), "text")


def concepts(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(i).cast("long").alias("concept_id"), F.lit(c).alias("concept")) for i, c in enumerate(CONCEPTS)])
    return spark.range(1).select(F.inline(rows))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(concept_id, concept) of the given table of parts: every fifth in capitals, every seventh with underscores, every ninth with a slash."""
    k = F.col("p_partkey")
    name = F.when(k % 5 == 0, F.initcap("p_name")).when(k % 7 == 0, F.replace("p_name", F.lit(" "), F.lit("_"))).when(k % 9 == 0, F.replace("p_name", F.lit(" "), F.lit("/"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select(k.cast("long").alias("concept_id"), name.alias("concept"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, concept_id, prob)."""
    return evaluate.image_probs(embeddings(spark, sf_dir))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, metric, concept, score): events as scores of generated images; every seventh is missing."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select((F.col("user_id") % 20).alias("model"), F.col("event_type").alias("metric"), (k % 20).alias("concept_id"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("score"))


def r6(x: Column) -> Column:
    return F.round(x, 6)


def values(rows: list[tuple], columns: str) -> str:
    def one(v) -> str:
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return f"(VALUES {', '.join('(' + ', '.join(one(v) for v in r) + ')' for r in rows)}) AS v({columns})"


SQL_CONCEPTS = f"concepts AS (SELECT concept_id::BIGINT AS concept_id, concept FROM {values(list(enumerate(CONCEPTS)), 'concept_id, concept')})"
INITCAP = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
SQL_NAMES = f"concepts AS (SELECT p_partkey::BIGINT AS concept_id, CASE WHEN p_partkey % 5 = 0 THEN {INITCAP} WHEN p_partkey % 7 = 0 THEN replace(p_name, ' ', '_') WHEN p_partkey % 9 = 0 THEN replace(p_name, ' ', '/') ELSE p_name END AS concept FROM part)"
SQL_TERMS = "terms AS (SELECT DISTINCT concept_id, concept, term FROM (SELECT concept_id, concept, unnest(regexp_split_to_array(lower(concept), '[_\\s]+')) AS term FROM concepts) WHERE term <> '')"
SQL_POST = "tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents), post AS (SELECT DISTINCT doc_id AS sample_id, w AS term FROM tok)"
STOPS = "('a', 'an', 'and', 'are', 'as', 'at', 'be', 'by', 'for', 'from', 'in', 'is', 'it', 'of', 'on', 'or', 'that', 'the', 'this', 'to', 'was', 'with')"
SQL_LEMMAS = f"lemma_post AS (SELECT DISTINCT sample_id, {lemma_sql('term')} AS term FROM post WHERE length(term) > 1 AND term NOT IN {STOPS})"
SQL_HITS = "known AS (SELECT * FROM terms WHERE term IN (SELECT term FROM post)), need AS (SELECT concept_id, count(*) AS k FROM known GROUP BY 1), hits AS (SELECT concept_id, concept, sample_id FROM known JOIN post USING (term) JOIN need USING (concept_id) GROUP BY concept_id, concept, sample_id, k HAVING count(*) = k)"
SQL_VEC = "e AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings)"
SQL_PROTO = f"{SQL_VEC}, pm AS (SELECT label, pos, avg(x) AS m FROM e GROUP BY ALL), pn AS (SELECT label, sqrt(sum(m * m)) AS n FROM pm GROUP BY label), proto AS (SELECT label, pos, m / n AS value FROM pm JOIN pn USING (label))"
SQL_SIMS = f"{SQL_PROTO}, sims AS (SELECT e.vec_id, any_value(e.label) AS truth, p.label, sum(e.x * p.value) AS sim FROM e JOIN proto p ON e.pos = p.pos GROUP BY e.vec_id, p.label)"
SQL_IMG = f"{SQL_SIMS}, img AS (SELECT vec_id AS sample_id, label::BIGINT AS concept_id, round(1 / (1 + exp(-6 * sim)), 6) AS prob FROM sims)"
SQL_SEARCH = f"{SQL_CONCEPTS}, {SQL_TERMS}, {SQL_POST}, {SQL_HITS}"
SQL_BOTH = f"{SQL_SEARCH}, {SQL_IMG}"
SQL_SCORES = "scores AS (SELECT user_id % 20 AS model, event_type AS metric, json_extract_string(props, '$.k')::BIGINT % 20 AS concept_id, CASE WHEN event_id % 7 <> 0 THEN value END AS score FROM events)"
SQL_DF = f"{SQL_POST}, df AS (SELECT term, count(*) AS df FROM post GROUP BY term)"
