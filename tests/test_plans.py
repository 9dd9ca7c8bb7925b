"""Plan shapes: pushed filters, pruned columns and partitions, shuffles that must not be there."""

import re

from pyspark.sql import functions as F

from freqloom.operators import index, search
from freqloom.plans import catalog
from freqloom.plans import fixtures as X
from freqloom.sources import sinks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_need_no_shuffle_and_two_columns(spark, sf_dir):
    p = plan(index.unigram_postings(X.corpus(spark, sf_dir)))
    assert "Exchange" not in p and re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", p)


def test_search_reads_the_corpus_once_and_moves_masks_only(spark, sf_dir):
    found = search.text_search(X.corpus(spark, sf_dir), X.concepts(spark))
    found.collect()
    p = plan(found).split("Initial Plan")[0]
    assert p.count("ReusedExchange") == 1 and "SortMergeJoin" not in p
    assert len(re.findall(r"FileScan parquet \[doc_id", p)) == 1


def test_filters_reach_the_scan(spark, sf_dir):
    keep = X.table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    assert "EqualTo(quality,1)" in plan(keep)


def test_thresholds_prune_partitions(spark, sf_dir, tmp_path):
    path = str(tmp_path / "p")
    sinks.write_thresholds(index.image_postings(X.images(spark, sf_dir), X.THRESHOLDS), path)
    one = spark.read.parquet(path).where(F.col("threshold") == 0.7)
    assert "PartitionFilters: [isnotnull(threshold" in plan(one)
    assert {f.split("/")[-2] for f in one.select("sample_id").inputFiles()} >= {"threshold=0.7"}
    assert one.count() == index.image_postings(X.images(spark, sf_dir), [0.7]).count()


def test_integrated_search_has_no_cartesian_product(spark, sf_dir):
    assert "CartesianProduct" not in plan(catalog.queries()["integrated_search"](spark, sf_dir))


def test_no_python_in_text_search(spark, sf_dir):
    for name in ("text_search_counts", "text_search_division", "concept_extract", "unigram_postings", "score_rows"):
        assert not re.search("Python|Pandas|Arrow", plan(catalog.queries()[name](spark, sf_dir)))


def test_similarities_broadcast_no_table_and_cross_nothing(spark, sf_dir):
    for name in ("image_probs", "zero_shot_accuracy", "cosine_topk", "retrieval_recall"):
        assert not re.search("CartesianProduct|BroadcastNestedLoop", plan(catalog.queries()[name](spark, sf_dir)))


def test_requests_prune_folders_at_run_time(spark, sf_dir, tmp_path):
    found = catalog.queries()["requested_search"](spark, sf_dir)
    found.collect()
    p = plan(found)
    assert re.search(r"PartitionFilters: \[.*dynamicpruning", p)
