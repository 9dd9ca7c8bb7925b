import pytest

from freqloom.streaming import corrections
from freqloom.streaming.postings import maintain_postings, postings


def test_postings_grow_with_new_files(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    schema = "sample_id long, text string"
    spark.createDataFrame([(0, "a dog"), (1, "dog")], schema).write.parquet(src)
    maintain_postings(spark, src, schema, out, ck).awaitTermination()
    spark.createDataFrame([(2, "cat dog")], schema).write.mode("append").parquet(src)
    maintain_postings(spark, src, schema, out, ck).awaitTermination()
    maintain_postings(spark, src, schema, out, ck).awaitTermination()
    got = sorted(tuple(r) for r in postings(spark, out).collect())
    assert got == [("a", 0), ("cat", 2), ("dog", 0), ("dog", 1), ("dog", 2)]


class Steps:
    """Documents in the order they are sent, and the index after each step."""

    def __init__(self, spark, folder, fan):
        self.spark, self.fan = spark, fan
        self.src, self.out, self.ck = (f"{folder}/{x}" for x in ("src", "out", "ck"))

    def send(self, *rows):
        self.spark.createDataFrame(list(rows), corrections.DOCUMENT).coalesce(1).write.mode("append").parquet(self.src)
        corrections.maintain(self.spark, self.src, self.out, self.ck, fan=self.fan).awaitTermination()
        found = [tuple(r) for r in corrections.postings(self.spark, self.out).collect()]
        assert len(found) == len(set(found))
        return set(found)


@pytest.mark.parametrize("fan", [2, 3])
def test_the_index_follows_its_documents(spark, tmp_path, fan):
    s = Steps(spark, tmp_path, fan)
    assert s.send((0, 1, "a dog"), (1, 1, "dog dog"), (2, 1, None), (None, 1, "x"), (3, None, "x")) == {("a", 0), ("dog", 0), ("dog", 1)}
    assert s.send((0, 2, "a cat"), (1, 1, "dog dog")) == {("a", 0), ("cat", 0), ("dog", 1)}  # changed, and sent again
    assert s.send((1, 2, None), (0, 1, "a dog")) == {("a", 0), ("cat", 0)}  # removed, and an old version
    assert s.send((1, 1, "dog"), (2, 2, "new")) == {("a", 0), ("cat", 0), ("new", 2)}
    assert s.send((1, 5, "x"), (1, 3, "y"), (1, 5, "a"), (0, 3, "dog cat")) == {("cat", 0), ("dog", 0), ("new", 2), ("x", 1)}
    runs = corrections.manifest(spark, s.out)
    assert max(level for level, _ in runs) >= 1 and all(sum(at == level for at, _ in runs) < fan for level, _ in runs)


def test_a_batch_that_is_repeated_replaces_itself(spark, tmp_path):
    import shutil

    s = Steps(spark, tmp_path, 2)
    s.send((0, 1, "a b"))
    want = s.send((0, 2, "b c"), (1, 1, "c"))
    commits = max((tmp_path / "ck/commits").glob("[0-9]*"), key=lambda f: int(f.name))
    commits.unlink()  # as if the driver had died before it noted the batch
    crc = commits.with_name(f".{commits.name}.crc")
    if crc.exists():
        crc.unlink()
    shutil.rmtree(tmp_path / f"out/manifest/batch={commits.name}")
    corrections.maintain(spark, s.src, s.out, s.ck, fan=2).awaitTermination()
    assert {tuple(r) for r in corrections.postings(spark, s.out).collect()} == want == {("b", 0), ("c", 0), ("c", 1)}


def test_documents_are_followed_without_a_call_for_each(spark, tmp_path):
    """No state of a Python function; merged runs go from the first terms to the last."""
    s = Steps(spark, tmp_path, 2)
    s.send(*[(k, 1, f"a w{k % 5} x") for k in range(40)])
    got = s.send(*[(k, 2, None if k % 7 == 0 else "b a") for k in range(0, 40, 3)], (1, 0, "old"))
    want = {(t, k) for k in range(40) for t in (["a", "w", "x"] if k % 3 else [] if k % 7 == 0 else ["a", "b"])}
    assert got == want and not (tmp_path / "ck/state").exists()
    (level, run), = corrections.manifest(spark, s.out)
    assert level == 1 and sorted(r.change for r in spark.read.parquet(f"{s.out}/runs/{run}").collect()) == [1] * len(want)
    assert spark.read.parquet(f"{s.out}/documents/{run}").count() == 40  # removed ones keep their version
