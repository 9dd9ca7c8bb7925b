from pyspark.sql import functions as F

from freqloom.plans import catalog, study_queries as Q


def test_members_are_digested_as_ordered_lists(spark):
    rows = spark.createDataFrame([("a", k * 1000, p) for k in (9, 10, 2, 30, 4) for p in (1, 0)] + [("b", 7, 0)], "concept string, conv_id long, pos int")
    got = {r.concept: (r.n, r.members) for r in Q.members(rows, "concept", ["conv_id", "pos"], F.concat_ws(":", "conv_id", "pos")).collect()}
    whole = ",".join(f"{k * 1000}:{p}" for k in (2, 4, 9, 10, 30) for p in (0, 1))
    assert got == {"a": (10, spark.range(1).select(F.sha2(F.lit(whole), 256)).first()[0]), "b": (1, spark.range(1).select(F.sha2(F.lit("7:0"), 256)).first()[0])}


def test_each_label_has_its_list(spark, sf_dir):
    done = catalog.queries()["label_samples"](spark, sf_dir)
    found = done.collect()
    assert done.columns == ["label", "classname", "paths"] and len({r.label for r in found}) == len(found)
    assert sum(len(r.paths.split(",")) for r in found) == spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
