import re

import pytest

from freqloom.llm import queries


@pytest.mark.parametrize("name", ["op2_scaled_sketch", "op4_url_rules", "op9_exact_dedup"])
def test_native_queries_run_no_python(spark, sf_dir, name):
    p = queries.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian", p)


@pytest.mark.parametrize("name", ["op1_compression_quality", "op3_byte_bpe"])
def test_row_by_row_queries_do_not_shuffle(spark, sf_dir, name):
    p = queries.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in p and "doc_id:bigint,text:string>" in p
