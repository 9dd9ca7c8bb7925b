import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from freqloom.llm import queries
from freqloom.llm import toxicity as X

from .helpers import LONG, awkward, empty


def invented(n=600, seed=1):
    """Texts of which insults make toxic ones; those mention women far oftener than clean ones do."""
    rng = random.Random(seed)
    plain = [f"wo{rng.randint(0, 999)}rd{k}".translate(str.maketrans("0123456789", "abcdefghij")) for k in range(80)]
    rows = []
    for k in range(n):
        toxic = int(rng.random() < 0.4)
        words = rng.choices(plain, k=rng.randint(8, 30)) + ["idiot"] * (toxic and rng.random() < 0.8) + ["scum"] * (toxic and rng.random() < 0.5)
        words += ["women"] * (rng.random() < (0.8 if toxic else 0.05)) + ["men"] * (rng.random() < 0.05)
        rng.shuffle(words)
        rows.append((k, " ".join(words) + ".", toxic))
    return rows


def fitted(spark, rows, **more):
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    return X.fit(docs, labels, **more)


def test_swapping_takes_the_weight_off_group_names(spark):
    rows = invented()
    free, fair = (fitted(spark, rows, fair=x) for x in (0.0, X.FAIR))
    texts = [t.replace("women", "men") for _, t, y in rows if not y][:100]
    shift = [np.mean([abs(X.Scorer(m).score(t) - X.Scorer(m).score(t + " women")) for t in texts]) for m in (free, fair)]
    assert shift[0] > 0.1 and shift[1] < shift[0] / 3
    neutral = [t + " The women here." for _, t, y in invented(seed=2) if not y]
    alarms = [np.mean([X.Scorer(m).score(t) >= X.FLAG for t in neutral]) for m in (free, fair)]
    assert alarms[1] < alarms[0] / 2
    caught = [t for _, t, y in invented(seed=2) if y and ("idiot" in t or "scum" in t)]
    assert np.mean([X.Scorer(fair).score(t) >= X.FLAG for t in caught]) > 0.9


def test_descent_finds_the_least_loss():
    rng = np.random.default_rng(4)
    x, changes = rng.normal(size=(200, 5)), rng.normal(size=(20, 5))
    y = (x[:, 0] + rng.normal(size=200) > 0.3).astype(float)

    def loss(b, w):
        z = x @ w + b
        return np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y)) + 0.3 / 200 * w @ w / 2 + 2 * np.mean((changes @ w) ** 2)

    b, w = X.logistic(x, y, changes, 2.0, 0.3, 2000)
    least = loss(b, w)
    for k in range(6):
        for step in (1e-3, -1e-3):
            moved = w + step * np.eye(6)[k][:5]
            assert loss(b + step * (k == 5), moved) >= least - 1e-9


def test_swaps_stay_within_groups():
    assert X.swapped("a woman and a muslim".split()) == ["a man and a christian".split(), "a person and a religious".split()]
    assert X.swapped("the men".split()) == [["the", "women"], ["the", "people"]] and X.swapped(["a", "house"]) == [] and X.swapped(["people"]) == []


def test_scores_of_features_and_of_the_scorer_agree():
    model = X.Model(-1.0, {"idi": 0.5, "=idiot": 0.7, X.LENGTH: -0.1, "=the": 0.01})
    text = "The IDIOT the idiots; idiot42 " * 3
    want = model.intercept + sum(model.weights.get(f, 0) * v for f, v in X.features(X.words(text)).items())
    assert abs(X.Scorer(model).score(text) - 1 / (1 + math.exp(-want))) < 1e-12


def test_awkward_rows_and_tables(spark):
    rows = invented()
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = X.fit(docs, labels)
    odd = awkward(spark).withColumn("__score", F.lit("clash"))
    got = X.score(odd, model)
    assert got.columns == [*odd.columns, "__score_"]
    found = got.collect()
    assert len(found) == odd.count() and all(0 <= r["__score_"] <= 1 for r in found)
    assert len({r["__score_"] for r in found if r.text in (None, "", " \n\t ")}) == 1
    assert next(r["__score_"] for r in found if r.text == LONG) == X.Scorer(model).score(LONG)
    assert X.score(empty(spark), model).count() == 0
    assert X.fit(empty(spark), labels.limit(0)).intercept == 0
    more = labels.unionByName(spark.createDataFrame([(None, 1), (1, None), (2, 7)], "doc_id long, toxic int"))
    assert X.fit(docs.unionByName(docs), more.unionByName(labels)) == model


def test_held_out_labels_are_never_read(spark):
    rows = invented()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = [(r[0], r[2]) for r in rows]
    other = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
    kind = "doc_id long, toxic int"
    assert labels != other and X.fit(docs, spark.createDataFrame(labels, kind)) == X.fit(docs, spark.createDataFrame(other, kind))


def test_query_is_right_on_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.1"
    got = queries.queries()["op11_counterfactual_toxicity"](spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert got.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    found = got.where("held_out").join(labels, "doc_id").select("predicted", "toxic", "doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in found)
    toxic = [r.predicted for r in found if r.toxic == 1]
    assert np.mean(toxic) >= 0.93 and np.mean([r.predicted for r in found if r.toxic == 0]) <= 0.01
