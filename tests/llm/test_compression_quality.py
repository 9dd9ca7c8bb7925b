import zlib

import numpy as np
from pyspark.sql import functions as F

from freqloom.llm import compression_quality as Q

from .helpers import ROWS, awkward, empty

LABELS = "doc_id long, quality int"


def test_held_out_fold(spark):
    rows = spark.range(-5, 300).withColumnRenamed("id", "doc_id").select("doc_id", Q.held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_logistic_recovers_a_slope():
    x = np.linspace(-3, 3, 4000)
    y = (np.random.default_rng(0).random(4000) < 1 / (1 + np.exp(-(0.5 + 2 * x)))).astype(float)
    a, b = Q.logistic(x, y)
    assert abs(a - 0.5) < 0.2 and abs(b - 2) < 0.3


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    done = Q.score(docs, Q.fit(docs, labels)).join(labels, "doc_id").where(Q.held_out()).select("__score", "quality").collect()
    good, bad = ([r[0] for r in done if r[1] == k] for k in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.95
    assert np.mean([g >= Q.KEEP for g in good]) > 0.97 and np.mean([b < Q.KEEP for b in bad]) > 0.6


def test_labels_of_the_held_out_fold_change_nothing(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    turned = labels.withColumn("quality", F.when(Q.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert Q.fit(docs, labels) == Q.fit(docs, turned)


def test_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (4, 1), (5, None), (None, 1), (6, 0), (7, 1), (99, 1)], LABELS).withColumn("label", F.lit("x"))
    for known in (labels, labels.where("quality = 1"), labels.limit(0)):
        done = Q.score(awkward(spark), Q.fit(awkward(spark), known)).collect()
        assert len(done) == len(ROWS) and all(0 <= r["__score"] <= 1 for r in done)
        assert {r["score"] for r in done} == {"clash"}
    model = Q.fit(empty(spark), labels)
    assert Q.score(empty(spark), model).count() == 0 and Q.keep_good(empty(spark), labels).count() == 0


def test_short_texts_get_about_the_base_rate(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    few = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    a, b = (r["__score"] for r in Q.score(few, Q.fit(docs, labels)).collect())
    assert a == b > 0.5


def test_one_long_text_does_not_use_up_the_sample(spark, monkeypatch):
    monkeypatch.setattr(Q, "TEXT_BYTES", 1000)
    monkeypatch.setattr(Q, "SAMPLE_BYTES", 6000)
    rows = [(k, ("long " if k % 10 == 0 else "") * 1000 + f"text {k} of class {k % 2} " * 5) for k in range(200)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], LABELS)
    got, totals = Q.sample(spark.createDataFrame(rows + rows[:50], "doc_id long, text string"), labels, "doc_id", "text", "quality")
    sizes = [sum(len(t) for t, y in got if y == k) for k in (0, 1)]
    assert all(5000 < x <= 6000 for x in sizes) and len(set(got)) == len(got) and sum(totals) == sum(zlib.crc32(str(k).encode()) % 5 != 0 for k in range(200))


def test_scores_equal_brute_force(spark, sf_dir):
    """The query against a plain loop over the model's own parts."""
    import math

    import zstandard

    from freqloom.llm.queries import op1_compression_quality

    docs, labels = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "labels"))
    model = Q.fit(docs, labels)
    want = {}
    for r in docs.collect():
        text, d = (r.text or "").encode(), 0
        for sign, data in ((1, model.bad), (-1, model.good)):
            c = zstandard.ZstdCompressor(level=Q.LEVEL, dict_data=zstandard.ZstdCompressionDict(data), write_content_size=False, write_checksum=False, write_dict_id=False)
            d += sign * sum(len(c.compress(text[i : i + 512])) for i in range(0, len(text), 512))
        x = (d + 48 * model.center) / (len(text) + 48)
        want[r.doc_id] = 1 / (1 + math.exp(-max(-30, min(30, model.intercept + model.slope * x))))
    got = op1_compression_quality(spark, sf_dir).collect()
    assert len(got) == len(want) and all(abs(r.score - want[r.doc_id]) < 1e-12 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_a_column_named_like_the_score_stays(spark):
    rows = spark.createDataFrame([(1, "a text", "mine")], "doc_id long, text string, __SCORE string")
    labels = spark.createDataFrame([(1, 1)], LABELS)
    assert Q.keep_good(rows, labels).collect() == rows.collect() and Q.score(rows, Q.fit(rows, labels)).columns[-1] == "__score_"
