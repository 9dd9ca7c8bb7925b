"""Pruned neighbours give what all pairs give, and read few blocks where vectors lie in clusters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from freqloom.operators import evaluate, neighbours


def table(spark, v, first=0):
    return spark.createDataFrame([(i + first, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")


def clustered(n, clusters, dim, spread, seed):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(clusters, dim))[rng.integers(0, clusters, n)] + spread * rng.normal(size=(n, dim))
    return v / np.linalg.norm(v, axis=1)[:, None]


@pytest.mark.parametrize("scale", [0.0, 1.5])
def test_top_k_equals_all_pairs(spark, scale):
    """Also for vectors of unlike lengths, equal ones and the zero vector."""
    rng = np.random.default_rng(3)
    v = clustered(700, 9, 8, 0.2, 1) * (1 + scale * rng.random((700, 1)))
    v[50:70] = v[7]
    v[80] = 0
    rows = table(spark, v)
    held = neighbours.cells(rows, pivots=20, block=16)
    queries = rows.where("vec_id % 9 = 7 OR vec_id IN (50, 80)")
    got = sorted(tuple(r) for r in neighbours.top_k(queries, held, 6).collect())
    assert got == sorted(tuple(r) for r in evaluate.top_k(queries, rows, 6).collect())


def test_top_k_of_few_and_none(spark):
    rows = table(spark, np.eye(4))
    held = neighbours.cells(rows, pivots=8, block=2)
    got = [tuple(r) for r in neighbours.top_k(rows.where("vec_id = 1"), held, 10).orderBy("rank").collect()]
    assert got == [(1, 1, 0, 0.0), (1, 2, 2, 0.0), (1, 3, 3, 0.0)]
    assert neighbours.top_k(rows.limit(0), held, 3).count() == 0
    assert neighbours.top_k(rows, neighbours.cells(rows.limit(0)), 3).count() == 0
    odd = rows.unionAll(spark.createDataFrame([(9, None)], rows.schema))
    assert neighbours.top_k(odd, neighbours.cells(odd, pivots=3, block=2), 1).count() == 4


def test_true_ranks_equal_all_pairs(spark):
    v = clustered(600, 7, 8, 0.15, 5)
    rows = table(spark, v).select("vec_id", F.floor(F.col("vec_id") / 3).alias("own_id"), F.col("embedding").alias("v"))
    texts = rows.where("vec_id % 3 > 0").withColumnRenamed("vec_id", "query_id")
    images = rows.where("vec_id % 3 = 0").withColumnRenamed("vec_id", "cand_id")
    held = neighbours.cells(images, "cand_id", "v", pivots=16, block=8)
    got = {r.query_id: r["rank"] for r in neighbours.true_ranks(texts, images, held).collect()}
    assert got == {r.query_id: r["rank"] for r in evaluate.true_ranks(texts, images).collect()}


def test_blocks_are_left_out(spark):
    rows = table(spark, clustered(4000, 40, 16, 0.02, 2))
    held = neighbours.cells(rows, pivots=120, block=32)
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"), F.lit(0.99).alias("least"))
    share = neighbours.open_blocks(asked, held).count() / (asked.count() * held.bounds.count())
    assert share < 0.1


def test_tiles_are_merged_and_sent_to_nobody_whole(spark):
    """Also with pivots: packs of queries meet packs of blocks, however many blocks stay open."""
    rows = table(spark, np.random.default_rng(9).normal(size=(300, 8))).select("vec_id", F.floor(F.col("vec_id") / 3).alias("own_id"), F.col("embedding").alias("v"))
    texts, images = rows.where("vec_id % 3 > 0").withColumnRenamed("vec_id", "query_id"), rows.where("vec_id % 3 = 0").withColumnRenamed("vec_id", "cand_id")
    for found in (evaluate.true_ranks(texts, images), neighbours.true_ranks(texts, images, neighbours.cells(images, "cand_id", "v", pivots=16, block=8))):
        told = found._jdf.queryExecution().toString()
        assert "SortMergeJoin [ask_block" in told and "HashJoin [ask_block" not in told
    told = evaluate.top_k(texts.withColumnRenamed("query_id", "vec_id"), rows, 3, vector="v")._jdf.queryExecution().toString()
    assert "SortMergeJoin [ask_block" in told and "HashJoin [ask_block" not in told


def test_packed_ranks_with_equal_and_close_vectors(spark):
    v = np.random.default_rng(2).normal(size=(90, 5)).astype(np.float32)
    v[30:60] = v[7]
    v[60:75] = v[8] * np.float32(1 + 1e-7)
    rows = spark.createDataFrame([(i, i // 3, x.tolist()) for i, x in enumerate(v)], "id long, own_id long, v array<float>")
    texts, images = rows.where("id % 3 > 0").withColumnRenamed("id", "query_id"), rows.where("id % 3 = 0").withColumnRenamed("id", "cand_id")
    sims = np.round(v.astype(float) @ v.astype(float).T, 9)
    held = [i for i in range(90) if i % 3 == 0]
    want = {i: 1 + sum((sims[i, c], -c) > (sims[i, i // 3 * 3], -(i // 3 * 3)) for c in held) for i in range(90) if i % 3}
    assert {r.query_id: r["rank"] for r in evaluate.true_ranks(texts, images).collect()} == want
    assert {r.query_id: r["rank"] for r in neighbours.true_ranks(texts, images, neighbours.cells(images, "cand_id", "v", pivots=4, block=8)).collect()} == want
