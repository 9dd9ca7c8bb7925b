import random

import pytest

from freqloom.llm import line_dedup
from freqloom.llm.line_dedup import LineRuns, dedup_lines, drop_lines

from .helpers import ROWS, awkward, docs, empty

BLANK = " \t\n\x0b\x0c\r"


def key(line):
    k = line.strip(BLANK)
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k)


def brute(rows, min_chars=20, min_docs=3):
    holds = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holds.setdefault(key(line), set()).add(-1 if i is None else i)
    lost = {k: max(v) for k, v in holds.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in lost or (-1 if i is None else i) >= lost[key(x)]]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_awkward_rows(spark):
    rows = [r[:2] for r in ROWS]
    assert got(dedup_lines(awkward(spark), min_docs=2)) == brute(rows, min_docs=2)
    assert dedup_lines(empty(spark)).count() == 0


@pytest.mark.parametrize("bucket_pairs", [500_000, 60])
def test_random_rows_equal_brute_force(spark, monkeypatch, bucket_pairs):
    monkeypatch.setattr(line_dedup, "BUCKET_PAIRS", bucket_pairs)
    random.seed(2)
    pool = ["  Repeated LINE of twenty characters ", "repeated line of twenty characters", "short", "É" * 20, "É" * 19, "", "another line that is rather long\r", *[f"a single line with the number {k}" for k in range(9)]]
    texts = [None if k % 17 == 0 else "\n".join(random.choice(pool) for _ in range(random.randint(0, 7))) for k in range(120)]
    rows = list(enumerate(texts))
    assert got(dedup_lines(docs(spark, texts))) == brute(rows)
    assert got(dedup_lines(docs(spark, texts), batches=5)) == brute(rows)


def test_other_columns_pass_through(spark):
    done = drop_lines(awkward(spark))
    assert done.columns[:-2] == awkward(spark).columns and done.columns[-2:] == ["__n_lines", "__n_dropped"]
    assert done.select("key").distinct().collect()[0][0] == "clash"


def test_runs_are_levelled(spark):
    runs = LineRuns(spark, buckets=2, fanout=2)
    for b in range(5):
        rows = [(d, bytes([k])) for d in range(b * 3, b * 3 + 3) for k in (0, b)] * 2
        runs.add(spark.createDataFrame(rows, "doc long, key binary"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    found = {bytes(r.key): (r.docs, r.top) for r in runs.frequent().collect()}
    assert found[b"\x00"] == (15, 14) and found[b"\x02"] == (3, 8)
    runs.drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]
    assert LineRuns(spark, 1).frequent().count() == 0


@pytest.mark.parametrize("min_docs", (2, 3, 5))
def test_batches_in_any_order_lose_each_line_once(spark, min_docs):
    random.seed(min_docs)
    runs, lost, holds = LineRuns(spark, buckets=1, min_docs=min_docs, fanout=3), [], {}
    ids = list(range(60))
    random.shuffle(ids)
    for b in range(6):
        rows = [(d, bytes([k])) for d in ids[b * 10 : b * 10 + 10] for k in {random.choice((0, 1, *range(2, 30))) for _ in range(4)}]
        for d, k in rows:
            holds.setdefault(k, set()).add(d)
        lost += [(r.doc, bytes(r.key)) for r in runs.add(spark.createDataFrame(rows, "doc long, key binary")).collect()]
    runs.drop()
    assert len(lost) == len(set(lost))
    assert set(lost) == {(d, k) for k, v in holds.items() if len(v) >= min_docs for d in v if d < max(v)}


def test_batches_move_no_run(spark):
    import re

    runs = LineRuns(spark, buckets=3)
    for b in range(2):
        runs.add(spark.createDataFrame([(b * 5 + d, bytes([k])) for d in range(5) for k in range(9)], "doc long, key binary"))
    keys = spark.createDataFrame([(bytes([k]), 1, 99) for k in range(4)], "key binary, docs long, last long")
    plan = runs.matched(keys)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and plan.count("Bucketed: true") == 2 and len(re.findall(r"\bExchange\b", plan)) == 1
    runs.drop()


def test_runs_go_when_a_batch_fails(spark):
    from freqloom.llm.line_dedup import lost_keys

    bad = spark.range(3).selectExpr("id AS doc", "if(id = 1, raise_error('x'), CAST('k' AS binary)) AS key").where("doc < 5")
    with pytest.raises(Exception):
        lost_keys(bad, 3, 2)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_columns_of_the_added_names_stay(spark):
    from pyspark.sql import functions as F

    names = ["__doc", "__keys", "__n_lines", "__N_dropped"]
    df = docs(spark, ["a line of over twenty characters"] * 4).withColumns({c: F.lit("mine") for c in names})
    done = drop_lines(df)
    assert done.columns == [*df.columns, "__n_lines_", "__n_dropped_"] and {tuple(r) for r in done.select(*names).collect()} == {("mine",) * 4}
    assert sum(r[0] for r in done.select("__n_dropped_").collect()) == 3


def test_runs_lie_in_the_shared_folder_and_go(spark):
    import glob

    from freqloom.llm.common import shared_dir

    folder = shared_dir(spark).removeprefix("file:")
    runs = LineRuns(spark, 2)
    runs.add(spark.createDataFrame([(1, b"some line"), (2, b"some line")], "doc long, key binary"))
    assert len(glob.glob(f"{folder}/line_run_*/*.parquet")) > 0 and "line_run" in spark.table(runs.names()[0]).inputFiles()[0]
    assert all(folder in x for x in spark.table(runs.names()[0]).inputFiles())
    runs.drop()
    assert not glob.glob(f"{folder}/line_run_*")
