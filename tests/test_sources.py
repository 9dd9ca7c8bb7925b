import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from freqloom.operators import prompts
from freqloom.sources import corpora, shards, sinks, splits, tar


def test_caption_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('a "cat\thttp://x/1\ntwo dogs\thttp://x/2\n')
    assert [tuple(r) for r in corpora.read_captions(spark, "cc3m", str(tmp_path / "a.tsv")).collect()] == [("http://x/1", 'a "cat'), ("http://x/2", "two dogs")]
    assert corpora.read_captions(spark, "cc12m", str(tmp_path / "a.tsv")).first().link == 'a "cat'
    rows = spark.createDataFrame([("t", "u"), ("", "u2"), ("t3", None)], "TEXT string, URL string")
    rows.write.parquet(str(tmp_path / "p"))
    assert [tuple(r) for r in corpora.read_captions(spark, "laion2b", str(tmp_path / "p")).collect()] == [("u", "t")]
    with pytest.raises(ValueError):
        corpora.read_captions(spark, "none", "x")


def test_dense_index_and_positional_replacement(spark):
    rows = spark.createDataFrame([(i * 7 % 50, str(i)) for i in range(50)], "k long, text string").repartition(7)
    got = {r.k: r.idx for r in corpora.dense_index(rows, ["k"]).collect()}
    assert got == {k: k for k in range(50)}
    lines = spark.createDataFrame([(i, f"line {i}") for i in range(50)], "n long, line string")
    assert {r.k: r.text for r in corpora.replace_by_position(rows, lines, ["k"], ["n"]).collect()} == {k: f"line {k}" for k in range(50)}
    with pytest.raises(ValueError):
        corpora.replace_by_position(rows, lines.limit(3), ["k"], ["n"])


def make_tar(path, files, cut=0):
    with tarfile.open(path, "w") as archive:
        for name, data in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            archive.addfile(info, io.BytesIO(data))
    if cut:
        data = open(path, "rb").read()
        open(path, "wb").write(data[:cut])


def test_tar_members_are_filtered_and_have_sidecars(spark, tmp_path):
    make_tar(tmp_path / "0.tar", {"2.JPG": b"two", "1.jpg": b"one", "1.json": b'{"a": 1}', "1.txt": b"caption", "notes.md": b"x"})
    got = sorted((r.name, bytes(r.content), r.sidecar) for r in tar.read_tar(spark, str(tmp_path)).collect())
    assert got == [("1.jpg", b"one", '{"a": 1}'), ("2.JPG", b"two", None)]
    texts = shards.texts_by_index(tar.read_tar(spark, str(tmp_path), extensions=(".txt",), sidecar="none"))
    assert [tuple(r) for r in texts.collect()] == [(1, "caption")]
    make_tar(tmp_path / "1.tar", {"3.jpg": b"x", "3.json": b"{"})
    with pytest.raises(Exception, match="no JSON beside 3"):
        tar.read_tar(spark, str(tmp_path)).collect()


def test_truncated_archive(spark, tmp_path):
    make_tar(tmp_path / "0.tar", {"1.jpg": b"a" * 600, "2.jpg": b"b" * 6000}, cut=2500)
    assert [r.name for r in tar.read_tar(spark, str(tmp_path)).collect()] == ["1.jpg"]
    with pytest.raises(Exception, match="(?i)read|eof|unexpected"):
        tar.read_tar(spark, str(tmp_path), tolerant=False).collect()


def test_sample_ids(spark):
    names = ["00012/00000007.jpg", "33.jpg", "x/00003.JPG", "none.jpg"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(shards.sample_id(F.col("n")).alias("i"))
    assert [r.i for r in rows.collect()] == [120007, 33, 3, None]


def test_split_files(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"train": [["a.jpg", 0, "cat"]], "val": [], "test": [["b.jpg", 1, "dog"]]}))
    assert {tuple(r) for r in splits.read_split_json(spark, str(tmp_path / "s.json")).collect()} == {("train", "a.jpg", 0, "cat"), ("test", "b.jpg", 1, "dog")}
    for c in ("zebra", "ant"):
        (tmp_path / "f" / c).mkdir(parents=True)
        (tmp_path / "f" / c / "1.jpg").write_bytes(b"x")
    assert {(r.classname, r.label) for r in splits.read_folders(spark, str(tmp_path / "f")).collect()} == {("ant", 0), ("zebra", 1)}
    (tmp_path / "v.txt").write_text("A 300\nB 7\n")
    (tmp_path / "l.txt").write_text("001 A 300\n002 C\n")
    assert [tuple(r) for r in splits.read_variants(spark, str(tmp_path / "l.txt"), str(tmp_path / "v.txt")).select("image_id", "classname").collect()] == [("001", "A 300")]
    assert splits.load_dataset("cifar10") is splits.read_table
    with pytest.raises(ValueError):
        splits.load_dataset("unknown")


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("cifar10", "cc3m", "text", "car", 5)], "downstream string, pt_dataset string, method string, concept string, n long")
    sinks.write_counts(rows, str(tmp_path / "c"))
    assert sinks.read_counts(spark, str(tmp_path / "c")).where("method = 'text'").first().n == 5
    (tmp_path / "cifar10_cc3m_lemmatized_search_counts.json").write_text('{"car": 3, "dog": 0}')
    got = {tuple(r) for r in sinks.read_count_json(spark, str(tmp_path)).collect()}
    assert got == {("cifar10", "cc3m", "lemmatized", "car", 3), ("cifar10", "cc3m", "lemmatized", "dog", 0)}
    old = spark.createDataFrame([("a", 1), ("b", 2)], "model string, v long")
    new = spark.createDataFrame([("b", 9), ("c", 3)], "model string, v long")
    assert {tuple(r) for r in sinks.upsert(old, new, ["model"]).collect()} == {("a", 1), ("b", 9), ("c", 3)}
    sinks.write_once(old, str(tmp_path / "o"))
    sinks.write_once(new, str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == 2


def test_bucketed_postings(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "term string, sample_id long")
    sinks.write_postings(rows, "postings_test", 4)
    assert spark.table("postings_test").where("term = 'a'").count() == 1
    spark.sql("DROP TABLE postings_test")


def test_a_bucket_is_written_by_several_tasks(spark):
    """A frequent term's postings don't meet in one task; a look-up by bucket still needs no shuffle."""
    rows = spark.range(3_000).selectExpr("CASE WHEN id < 2000 THEN 'the' ELSE 'w' || id END AS term", "id AS sample_id")
    sinks.write_postings(rows, "postings_spread", 4)
    table = spark.table("postings_spread")
    held = table.where("term = 'the'").groupBy(F.input_file_name()).count().collect()
    assert len(held) > 1 and sum(r["count"] for r in held) == 2_000
    files = [x.rpartition("/")[2] for x in table.inputFiles()]
    assert len(files) <= 8 and {x.rpartition("_")[2][:5] for x in files} == {f"{k:05d}" for k in range(4)}
    counts = table.groupBy("term").count()
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString() and counts.count() == 1_001
    spark.sql("DROP TABLE postings_spread")


def test_positions_of_other_ids_fail(spark):
    rows = spark.createDataFrame([(k,) for k in range(5)], "id long")
    lines = spark.createDataFrame([(k, f"line {k}") for k in (0, 1, 2, 4, 5)], "item long, line string")
    with pytest.raises(Exception, match="other id at position 3"):
        corpora.replace_by_position(rows, lines, ["id"], ["item"], same=("id", "item")).collect()
    assert corpora.replace_by_position(rows.where("id < 3"), lines.where("item < 3"), ["id"], ["item"], same=("id", "item")).count() == 3


def test_class_lists(spark):
    rows = spark.createDataFrame([("b", 1, "two"), ("a", 1, "two"), ("c", 0, "one")], "path string, label int, classname string")
    assert {r.label: r.paths for r in splits.samples_of(rows).collect()} == {0: ["c"], 1: ["a", "b"]}
    assert {r.label: r.classname for r in splits.class_list(rows).collect()} == {0: "one", 1: "two"}
    for bad in (("d", 0, "other"), ("d", 2, "two")):
        with pytest.raises(Exception, match="is not one class"):
            splits.class_list(rows.union(spark.createDataFrame([bad], rows.schema))).collect()
    assert {splits.load_dataset(x) for x in ("caltech256", "cub", "birdsnap")} == {splits.read_split_json}


def test_map_json(spark, tmp_path):
    sinks.write_map_json(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long"), "k", "v", str(tmp_path / "m"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "m")).collect()) == ['{"a":1}', '{"b":2}']


def test_flat_list(spark, tmp_path):
    (tmp_path / "l.json").write_text('[{"cat": ["a", "b"]}, {"dog": []}, {"cat": ["c"]}]')
    got = {r.concept: r.entries for r in sinks.read_flat_list(spark, str(tmp_path), split=9).collect()}
    assert got == {"cat": ["c"], "dog": []}


def test_split_files_are_read_in_ranges(spark, tmp_path):
    items = [[f"{i}, [\"x\"].jpg", str(i % 3), "a {class}"] for i in range(200)]
    (tmp_path / "s.json").write_text(json.dumps({"other": [1], "train": items[:120], "val": [], "test": items[120:]}))
    rows = splits.read_split_json(spark, str(tmp_path), split=700)
    assert sorted(tuple(r) for r in rows.collect()) == sorted(("train" if i < 120 else "test", p, int(label), c) for i, (p, label, c) in enumerate(items))
    spark.createDataFrame([("none", "x", 1, "y"), (None, "x", 1, "y")], rows.schema).unionByName(rows).write.parquet(str(tmp_path / "rows"))
    splits.write_split_json(spark.read.parquet(str(tmp_path / "rows")), str(tmp_path / "again"))
    assert sorted(map(tuple, splits.read_split_json(spark, str(tmp_path / "again"), suffix=".txt").collect())) == sorted(map(tuple, rows.collect()))


def test_counts_and_hits_in_folders(spark, tmp_path):
    rows = spark.createDataFrame([("d", "c", m, f'the "{k}"', k) for m in ("text", "image") for k in range(5)], "downstream string, pt_dataset string, method string, concept string, n long")
    sinks.write_count_json(rows, str(tmp_path / "c"))
    assert sorted(map(tuple, sinks.read_count_json(spark, str(tmp_path / "c"), suffix=".txt", split=4).collect())) == sorted(map(tuple, rows.collect()))
    sinks.write_hits(rows.withColumnRenamed("n", "sample_id"), str(tmp_path / "h"))
    found = sinks.read_hits(spark, str(tmp_path / "h")).where("method = 'text' AND concept = 'the \"3\"'")
    assert [r.sample_id for r in found.collect()] == [3]
    assert "PartitionFilters: [isnotnull(method" in found._jdf.queryExecution().toString()


def test_prompt_banks(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"birds": ["Show {} {}, a bird", "Show {} {}, a bird", "{}"], "places": ["in {}", None]}))
    concepts = spark.createDataFrame([("birds", "Owl"), ("places", "Peru"), ("none", "x")], "dataset string, concept string")
    got = {tuple(r) for r in prompts.expand_sets(concepts, prompts.read_banks(spark, str(tmp_path), "long")).collect()}
    assert got == {("birds", "Owl", "long", "Show an Owl, a bird"), ("birds", "Owl", "long", "Owl"), ("places", "Peru", "long", "in Peru")}


def test_archives_are_chosen_before_they_are_read(spark, tmp_path):
    for name in ("a", "b"):
        make_tar(tmp_path / f"{name}.tar", {"1.jpg": b"x"})
    got = tar.read_tar(spark, str(tmp_path), archives="/b.tar").collect()
    assert len(got) == 1 and got[0].archive.endswith("/b.tar")


def test_views(spark, sf_dir):
    from freqloom.plans import catalog

    catalog.register_views(spark, sf_dir, ["region", "nation"])
    assert spark.sql("SELECT count(*) FROM nation JOIN region ON n_regionkey = r_regionkey").first()[0] == 25
