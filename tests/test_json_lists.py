"""Lists cut at any byte give the elements of the whole file."""

import json
import random

import pytest
from pyspark.sql import functions as F

from freqloom.sources import json_lists as J


def texts(rng):
    pieces = ['"', "\\", "\\\\", '\\"', "[", "]", "{", "}", ",", "é", "\n", "a", " ", " ", "😀"]
    return "".join(rng.choices(pieces, k=rng.randint(0, 12)))


def value(rng, deep=0):
    kind = rng.randint(0, 5 if deep < 3 else 3)
    if kind == 4:
        return [value(rng, deep + 1) for _ in range(rng.randint(0, 3))]
    if kind == 5:
        return {texts(rng): value(rng, deep + 1) for _ in range(rng.randint(0, 3))}
    return [texts(rng), rng.randint(-9, 9), None, True][kind]


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_elements_at_any_cut(spark, tmp_path, split, monkeypatch):
    rng = random.Random(split)
    want = []
    for k in range(3):
        items = [value(rng) for _ in range(rng.randint(3, 8))]
        plain, spread = json.dumps(items, ensure_ascii=k % 2 == 0), json.dumps(items[:2], indent=1)
        (tmp_path / f"{k}.json").write_bytes((b"\xef\xbb\xbf" if k == 1 else b"") + f" {plain}\n[ ]{spread} ".encode())
        want.append(items + items[:2])
    (tmp_path / "none.json").write_text("")
    found = J.read_elements(spark, str(tmp_path), split=split).orderBy("file", "at").collect() if split > 1 else None
    if found is None:  # thousands of ranges: without Spark
        for k, items in enumerate(want):
            data = (tmp_path / f"{k}.json").read_bytes()
            with J.opened(str(tmp_path / f"{k}.json")) as file:
                odd, depth, got = 0, 0, []
                for at in range(len(data)):
                    got += [json.loads(e) for _, e, _ in J.elements(file, at, at + 1, len(data), odd, depth)]
                    o, outside, inside = J.summed(file, at, at + 1)
                    odd, depth = (odd + o) % 2, depth + (inside if odd else outside)
            assert got == items
        return
    for k, items in enumerate(want):
        assert [json.loads(r.element) for r in found if r.file.endswith(f"/{k}.json")] == items


def test_a_list_is_read_by_several_tasks(spark, tmp_path):
    rows = [{"image_path": f"{i}.jpg", "caption": [f"A dog-{i}, \"big\"", "cat"], "union_label_id": [i % 5, 7], "parse_label_id": [[i % 5], []]} for i in range(3000)]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    found = J.read_json_list(spark, str(tmp_path / "a.json"), J.ANNOTATION, split=20_000)
    spread = found.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    assert sum(r.n for r in spread) == 3000 and max(r.n for r in spread) < 1500
    each = J.annotations(found).where("image_path = '8.jpg'").orderBy("pos").collect()
    assert [(r.pos, r.image_tags, r.caption_tags) for r in each] == [(0, [3, 7], [3]), (1, [3, 7], [])]
    one = J.one_caption(found).collect()
    assert len(one) == 3000 and {r.pos for r in one} == {0, 1}
    assert found.where("image_path = '8.jpg'").select(J.multi_hot(F.col("union_label_id"), 8)).head()[0] == [0, 0, 0, 1, 0, 0, 0, 1]


@pytest.mark.parametrize("text", ['{"a": [1]}', "[1, 2", '["a', "[[1]", "[1], 2]["])
def test_what_is_no_list_fails(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception, match="JSON list"):
        J.read_elements(spark, str(tmp_path), split=3).collect()


def test_no_file(spark, tmp_path):
    assert J.read_elements(spark, str(tmp_path)).count() == 0


def spread(value, rng):
    """JSON of a value with blanks of any length after brackets, colons and commas of the first two levels."""
    blank = lambda: " " * rng.choice([0, 1, 400]) + "\n" * rng.randint(0, 1)
    dumps = lambda v: json.dumps(v, ensure_ascii=False)
    arrays = [f"{blank()}{dumps(k)}{blank()}:{blank()}" + (f"[{blank()}" + f"{blank()},{blank()}".join(map(dumps, v)) + f"{blank()}]" if isinstance(v, list) else dumps(v)) for k, v in value.items()]
    return "{" + ",".join(arrays) + blank() + "}"


@pytest.mark.parametrize("split", [67, 1 << 20])
def test_arrays_of_objects_keep_their_key(spark, tmp_path, split):
    rng = random.Random(split)
    want = []
    for k in range(2):
        tables = [{texts(rng) + '\\"k' * rng.randint(0, 2) + str(i): [value(rng) for _ in range(rng.randint(0, 3))] for i in range(3)} | {"plain": 7} for _ in range(2)]
        (tmp_path / f"{k}.json").write_text("\n".join(spread(t, rng) for t in tables))
        want += [(str(k), key, v) for t in tables for key, vs in t.items() if isinstance(vs, list) for v in vs]
    found = J.read_elements(spark, str(tmp_path), split=split, kind=J.LISTS).orderBy("file", "at").collect()
    assert [(r.file[-6], r.key, json.loads(r.element)) for r in found] == want


@pytest.mark.parametrize("split", [6, 1 << 20])
def test_entries_of_objects(spark, tmp_path, split):
    rng = random.Random(split)
    table = {texts(rng) + str(i): rng.randint(-9, 9) for i in range(9)}
    (tmp_path / "x.json").write_text(json.dumps(table) + "{ }" + json.dumps({"more": 1}))
    found = J.read_json_map(spark, str(tmp_path), "long", split=split).orderBy("at").collect()
    assert [(r.key, r.value) for r in found] == [*table.items(), ("more", 1)]


@pytest.mark.parametrize("text", ['{"a": {"b": [1]}}', "[1]", '{"a": [1]}[2]', '{"a": [1'])
def test_what_is_no_object_of_arrays_fails(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception, match="JSON list"):
        J.read_json_lists(spark, str(tmp_path), "int", split=3).collect()
