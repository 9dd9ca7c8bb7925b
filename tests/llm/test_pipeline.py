import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from freqloom.llm import queries
from tests.oracle import assert_same, connect

from .helpers import awkward, empty
from .test_line_dedup import brute as brute_lines
from .test_near_dedup import brute_kept
from .test_records import packed

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    assert_same(queries.queries()[name](spark, sf_dir), connect(sf_dir), queries.oracle_sql()[name])


def test_all_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {f"op{n}_" for n in range(1, 11)} == {x.split("_")[0] + "_" for x in names if x.startswith("op")}
    assert "pipeline" in names


def test_stages_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality"](spark, docs, sf_dir)
    assert kept.columns == COLUMNS and 0 < kept.count() <= docs.count()
    rows = {r.doc_id: r.text for r in kept.collect()}
    lines = stages["line_dedup"](spark, kept, sf_dir)
    assert lines.columns == COLUMNS
    after = {r.doc_id: (r.text, r.n_chars) for r in lines.collect()}
    want = {i: t for i, _, _, t in brute_lines(list(rows.items()))}
    assert after == {i: (t, len(t)) for i, t in want.items()}
    ids = sorted(want)
    near = stages["near_dedup"](spark, lines, sf_dir)
    assert near.columns == COLUMNS and sorted(r.doc_id for r in near.collect()) == [ids[k] for k in brute_kept([want[i] for i in ids])]
    parts = {}
    for r in sorted(stages["packing"](spark, near, sf_dir).collect(), key=lambda r: (r.doc_id, r.segment)):
        parts[r.doc_id] = parts.get(r.doc_id, b"") + bytes(r.ids)
    assert parts == {r.doc_id: packed(r.text) + b"\1\0" for r in near.collect()}


def test_run_equals_its_stages(spark, sf_dir):
    packed = corpus_pipeline.run(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    digest = [hashlib.sha256(repr(sorted(map(tuple, d.collect()))).encode()).hexdigest() for d in (packed, docs)]
    assert digest[0] == digest[1]


def test_stages_take_awkward_and_empty_tables(spark, sf_dir):
    for rows in (awkward(spark, extra=False), empty(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, sf_dir)
            assert rows.columns == COLUMNS
        corpus_pipeline.STAGES[-1][1](spark, rows, sf_dir).collect()


def test_stages_keep_columns_of_any_name(spark, sf_dir):
    names = ["__score", "__doc", "__keys", "__n_lines", "__n_dropped", "__id", "__nth", "__digest", "node", "ids", "length", "segment", "width", "bucket"]
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({c: F.lit(f"mine {c}") for c in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, sf_dir)
        assert rows.columns == COLUMNS + names
    assert {tuple(r) for r in rows.select(*names).collect()} == {tuple(f"mine {c}" for c in names)}
    assert corpus_pipeline.STAGES[-1][1](spark, rows, sf_dir).count() >= rows.count()
