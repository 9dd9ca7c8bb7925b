"""Tar data source, positional and bitmap indexes, the automaton, multi-index hashing."""

import io
import json
import os
import random
import re
import tarfile

import pytest
from pyspark.sql import functions as F

from freqloom.operators import automaton, bitmaps, curate, index, phrases, search
from freqloom.plans import catalog
from freqloom.sources import tar

from .oracle import assert_same


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def archive(path, files):
    with tarfile.open(path, "w") as out:
        for name, data in files:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            out.addfile(info, io.BytesIO(data))


@pytest.fixture
def folder(tmp_path):
    random.seed(1)
    for k in range(3):
        files = []
        for i in range(40):
            files.append((f"{k:05d}/{i:08d}.jpg", random.randbytes(random.randint(0, 3000))))
            if i % 3:
                files.append((f"{k:05d}/{i:08d}.json", json.dumps({"i": i}).encode()))
            files.append((f"{'long' * 40}/{k}-{i}.txt", b"text"))
        archive(tmp_path / f"{k:05d}.tar", files)
    return str(tmp_path)


def test_tar_members_come_in_byte_ranges(spark, folder):
    whole = tar.read_members(spark, folder)
    want = sorted((r.name, r.content) for r in whole.collect())
    assert len(want) == 3 * (40 + 26 + 40) and whole.rdd.getNumPartitions() == 3
    tar.tar_index(spark, folder).write.parquet(f"{folder}/index")
    for options in ({"split": 10_000}, {"split": 10_000, "index": f"{folder}/index"}, {"split": 777}):
        cut = tar.read_members(spark, folder, **options)
        assert cut.rdd.getNumPartitions() > 20 and sorted((r.name, r.content) for r in cut.collect()) == want


def test_tar_filters_reach_the_reader(spark, folder):
    few = tar.read_members(spark, folder, split=10_000, names=".JSON, .none", archives="00001.tar")
    assert few.count() == 26 and {r.archive[-9:] for r in few.collect()} == {"00001.tar"}
    every = tar.read_members(spark, folder, split=10_000)
    assert few.rdd.getNumPartitions() < every.rdd.getNumPartitions() / 2  # other archives have no partitions
    both = every.where(F.col("name").endswith(".json")).select("name").unionAll(every.where(F.col("name").endswith(".txt")).select("name"))
    assert both.count() == 3 * (26 + 40)  # branches of one reader


def test_tar_members_with_sidecars_are_what_the_whole_file_reader_gives(spark, folder):
    want = []
    for k in range(3):
        with tarfile.open(f"{folder}/{k:05d}.tar") as whole:
            held = {m.name: whole.extractfile(m).read() for m in whole}
        texts = {name: held.get(name.replace(".jpg", ".json")) for name in held if name.endswith(".jpg")}
        want += [(f"{k:05d}.tar", name, held[name], text and text.decode()) for name, text in texts.items()]
    got = tar.read_tar(spark, folder, split=5_000).collect()
    assert sorted((r.archive.rpartition("/")[2], r.name, bytes(r.content), r.sidecar) for r in got) == sorted(want)


def test_tar_of_over_two_gigabytes_in_several_partitions(spark, tmp_path):
    """A sparse archive: holes between small members, read in ranges without any of them in one value."""
    path = tmp_path / "large.tar"
    with open(path, "wb") as out:
        for k in range(5):
            for name, size in ((f"{k}.jpg", 10), (f"{k}.bin", 700 << 20)):
                info = tarfile.TarInfo(name)
                info.size = size
                out.write(info.tobuf())
                if size == 10:
                    out.write(b"0123456789" + b"\0" * 502)
                else:
                    out.seek(size, os.SEEK_CUR)
        out.write(b"\0" * 1024)
    assert path.stat().st_size > 3 << 30
    found = tar.read_members(spark, str(path), split=512 << 20, names=".jpg")
    assert found.rdd.getNumPartitions() >= 6 and sorted((r.name, r.content) for r in found.collect()) == [(f"{k}.jpg", b"0123456789") for k in range(5)]


def test_tar_ranges_read_their_own_headers(spark, tmp_path):
    """Each range begins at its first header, long names included; only what a global header tells is walked from the start."""
    for kind, form in (("gnu", tarfile.GNU_FORMAT), ("pax", tarfile.PAX_FORMAT), ("global", tarfile.PAX_FORMAT)):
        with tarfile.open(tmp_path / f"{kind}.tar", "w", format=form, pax_headers={"comment": "x"} if kind == "global" else None) as out:
            for i in range(60):
                info = tarfile.TarInfo(f"{'d' * (150 if i % 3 else 5)}/{i}.txt")
                info.size = 9_000 if i % 20 == 7 else i
                if i % 5 == 4:
                    info.type, info.size = tarfile.DIRTYPE, 0
                out.addfile(info, io.BytesIO(bytes(info.size)))
    for split in (512, 4_096):
        found = tar.read_members(spark, str(tmp_path), split=split)
        got = [(r.archive[-8:], r.name, r.size) for r in found.collect()]
        assert len(got) == len(set(got)) == 3 * 48
        starts = tar.range_starts(spark, [f"file://{tmp_path}/{k}.tar" for k in ("gnu", "pax", "global")], split).collect()
        for r in starts:
            assert r.first == 0 if r.archive.endswith("global.tar") or r.range == 0 else r.first // split == r.range
        ranges = tar.TarReader({"path": str(tmp_path), "split": str(split)}).partitions()
        assert len(ranges) == found.rdd.getNumPartitions() and len(starts) < len(ranges)


def test_truncated_tar(spark, tmp_path):
    archive(tmp_path / "a.tar", [(f"{k}.jpg", bytes(600)) for k in range(10)])
    data = (tmp_path / "a.tar").read_bytes()
    for end, what in ((5000, "header"), (5300, "member")):
        (tmp_path / "a.tar").write_bytes(data[:end])
        assert tar.read_members(spark, str(tmp_path)).count() == 3
        with pytest.raises(Exception, match=f"ends in a {what}"):
            tar.read_members(spark, str(tmp_path), tolerant=False).collect()
    (tmp_path / "none").mkdir()
    assert tar.read_members(spark, str(tmp_path / "none")).count() == 0


def test_phrases_of_any_length(spark):
    random.seed(2)
    texts = [" ".join(random.choices("abcd", k=random.randint(0, 30))) for _ in range(200)] + [None, ""]
    asked = ["a", "a b", "a a", "a b a b", "a b c d a", "zz", "a zz", "", None, "A-b"]
    corpus = spark.createDataFrame(list(enumerate(texts)), "sample_id long, text string")
    asking = spark.createDataFrame(list(enumerate(asked)), "phrase_id long, phrase string")
    want = {}
    for p, phrase in enumerate(asked):
        words = re.findall("[a-z]+", (phrase or "").lower())
        for i, t in enumerate(texts):
            have = re.findall("[a-z]+", t or "")
            n = sum(have[k : k + len(words)] == words for k in range(len(have) - len(words) + 1)) if words else 0
            if n:
                want[(p, i)] = n
    for only in (None, phrases.phrase_terms(asking)):
        got = phrases.phrase_search(phrases.positional_postings(corpus, only=only), asking)
        assert {(r.phrase_id, r.sample_id): r.n for r in got.collect()} == want


def test_bitmaps_hold_all_ids(spark):
    ids = [0, -1, -40_000, 1, 2, 32_768, 32_769, 65_536, 65_537, 10**12, 7]
    rows = [("a", i) for i in ids] + [("a", 7), ("b", 1), ("b", 10**12)]
    made = bitmaps.bitmap_postings(spark.createDataFrame(rows, "term string, sample_id long"))
    got = made.select("term", F.explode(bitmaps.ids_of(F.col("bucket"), F.col("bits"))).alias("i")).collect()
    assert sorted(r.i for r in got if r.term == "a") == sorted(ids) and sorted(r.i for r in got if r.term == "b") == [1, 10**12]
    assert {r.term: r.df for r in bitmaps.doc_freq(made).collect()} == {"a": len(ids), "b": 2}


def test_bitmap_search_equals_relational_division(spark, sf_dir):
    from freqloom.plans import fixtures as X

    post = index.unigram_postings(X.corpus(spark, sf_dir))
    got = bitmaps.hits(bitmaps.bitmap_search(bitmaps.bitmap_postings(post), X.concepts(spark)))
    want = search.text_search_postings(post, X.concepts(spark))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()} and got.count() > 0


def test_bitmaps_are_not_shuffled(spark, sf_dir):
    """Postings are, by term and bucket; a search keeps its bitmaps and reads the postings once."""
    from freqloom.plans import fixtures as X

    post = index.unigram_postings(X.corpus(spark, sf_dir))
    p = plan(bitmaps.bitmap_postings(post))
    assert p.count("Exchange") == 1 and "REPARTITION_BY_NUM" in p and "Aggregate" not in p.split("Exchange")[1]
    assert "documents.parquet" not in plan(bitmaps.bitmap_search(bitmaps.bitmap_postings(post), X.concepts(spark)))


def test_dense_bitmaps_are_read_whole(spark):
    ids = [*range(1, 2 * bitmaps.BITS + 1), *range(-bitmaps.BITS, 1, 3)]
    made = bitmaps.bitmap_postings(spark.createDataFrame([(i,) for i in ids], "sample_id long").selectExpr("'a' AS term", "sample_id"))
    got = made.select(F.explode(bitmaps.ids_of(F.col("bucket"), F.col("bits"))).alias("i")).collect()
    assert sorted(r.i for r in got) == sorted(ids)


def test_pairs_are_counted_where_they_are_dealt(spark, sf_dir):
    """No task keeps the pairs of its documents: nothing is counted under the exchange."""
    p = plan(catalog.queries()["phrase_postings"](spark, sf_dir))
    assert p.count("Exchange") == 1 and "REPARTITION_BY_NUM" in p and "HashAggregate" not in p.split("Exchange")[1]
    rows = spark.createDataFrame([("a b", 1), ("a b", 2), ("b c", 1)], "phrase string, sample_id long")
    assert sorted(map(tuple, index.doc_freq(rows, "phrase", many=True).collect())) == [("a b", 2), ("b c", 1)]


def test_automaton_finds_what_the_definition_says(spark):
    from freqloom.functions import text as T

    random.seed(4)
    concepts = ["cat", "hot_air balloon", "balloon", "air", "a", "Dog", "cats", "x"]
    texts = [(k, " ".join(random.choices(["cat", "cats,", "hot", "air", "balloon!", "Dog", "dogs", "category", "a", "x1"], k=random.randint(0, 8)))) for k in range(120)] + [(500, None), (501, "")]
    rows, names = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(c,) for c in [*concepts, "cat", None]], "concept string")
    want = rows.join(names.distinct(), T.mentions(F.col("text"), F.replace("concept", F.lit("_"), F.lit(" ")))).select("concept", "id")
    for most in (100, 3):
        assert sorted(map(tuple, automaton.mentions(rows, names, "id", most=most).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("radius", [0, 4, 10, 13, 22, 30])
def test_hash_pairs_at_any_radius(spark, radius):
    random.seed(radius)
    base = [random.getrandbits(64) for _ in range(6)]
    rows = []
    for k in range(220):
        h = random.choice(base)
        for _ in range(random.randint(0, 30)):
            h ^= 1 << random.randrange(64)
        rows.append((k, random.randint(0, 1), h - (1 << 64) if h >> 63 else h))
    rows += [(300, 0, rows[0][2]), (301, rows[0][1], rows[0][2])]
    got = curate.hash_pairs(spark.createDataFrame(rows, "id long, g int, h long"), "g", "id", "h", radius)
    least = {}
    for i, g, h in rows:
        least[(g, h)] = min(i, least.get((g, h), i))
    reps = [(i, g, h) for (g, h), i in least.items()]
    want = {(g, i, j, (h ^ x).bit_count() if (h ^ x) >= 0 else ((h ^ x) & ((1 << 64) - 1)).bit_count()) for i, g, h in reps for j, f, x in reps if g == f and i < j}
    assert sorted(map(tuple, got.collect())) == sorted(w for w in want if w[3] <= radius)
    p = plan(got)
    assert "CartesianProduct" not in p and "NestedLoop" not in p and "value" in re.search(r"(SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin) \[([^\]]*)\]", p)[2]


def test_no_query_matches_all_pairs(spark, sf_dir):
    for name in ("prompt_contains", "hamming_dups", "hamming_classes", "greedy_dedup", "bitmap_text_search", "phrase_search"):
        assert not re.search("CartesianProduct|NestedLoop", plan(catalog.queries()[name](spark, sf_dir)))


def test_hash_pairs_ship_blocks_and_no_looked_up_rows(spark):
    """Many hashes of a group, in blocks of any number: no side of the join is multiplied row by row."""
    random.seed(8)
    base = [random.getrandbits(63) for _ in range(40)]
    rows = [(k, k % 2, random.choice(base) ^ (1 << random.randrange(63)) ^ (1 << random.randrange(63))) for k in range(900)] + [(2000, None, base[0]), (2001, 1, None)]
    df = spark.createDataFrame(rows, "id long, g int, h long")
    want = sorted(map(tuple, curate.hash_pairs(df, "g", "id", "h", 22).collect()))
    for block in (7, 64):
        got = curate.hash_pairs(df, "g", "id", "h", 22, block=block)
        assert sorted(map(tuple, got.collect())) == want and want
        assert "Generate" not in plan(got)


def test_hamming_dups_leave_out_no_pair_of_vectors(spark, tmp_path):
    """Vectors of equal signs and copies each have all their pairs, and so have vectors that lack elements."""
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    random.seed(12)
    flip = lambda v, n: [-x if k < n else x for k, x in enumerate(v)]
    v = [random.choice([-1.0, 1.0]) * random.uniform(0.1, 1) for _ in range(64)]
    vectors = [v, [2 * x for x in v], v, flip(v, 22), flip(v, 23), [None, *flip(v, 23)[1:]], flip(v, 30)[:22], flip(v, 30)[:24], v[:5], [0.0] * 64, [None] * 64, [], None, flip(v, 40), flip(v, 41)]
    rows = [(k, x, 1) for k, x in enumerate(vectors)] + [(20, v, 2), (21, v, None), (None, v, 1), (3, flip(v, 1), 1)]
    ids, lists, labels = zip(*rows)
    table = pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(lists, pa.list_(pa.float32())), "label": pa.array(labels, pa.int32())})
    pq.write_table(table, tmp_path / "embeddings.parquet")
    want = []
    for a, x, g in rows:
        for b, y, f in rows:
            if x is not None and y is not None and g is not None and g == f and a is not None and b is not None and a < b:
                differ = [(s > 0) != (t > 0) for s, t in zip(x, y) if s is not None and t is not None]
                if differ and sum(differ) <= 22:
                    want.append((g, a, b, sum(differ)))
    got = catalog.queries()["hamming_dups"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert {(1, 0, 1, 0), (1, 0, 2, 0), (1, 1, 2, 0), (1, 2, 3, 22), (1, 0, 5, 22)} <= set(want)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    assert_same(got, db, catalog.oracle_sql()["hamming_dups"])


def test_row_pairs_of_copies_and_unknown_bits_in_any_blocks(spark):
    random.seed(13)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    base = [random.getrandbits(64) for _ in range(12)]
    rows = []
    for k in range(300):
        h, known = random.choice(base), (1 << 64) - 1
        for _ in range(random.choice([0, 0, 3, 14])):
            h ^= 1 << random.randrange(64)
        if k % 3 == 0:
            known = random.getrandbits(64) | random.getrandbits(64)
        rows.append((k, k % 2, h, known))
    df = spark.createDataFrame([(k, g, signed(h), signed(known)) for k, g, h, known in rows], "id long, g int, h long, known long")
    for radius, block in ((5, 16), (22, 16), (22, 4096)):
        want = sorted((g, i, j, d) for i, g, h, k in rows for j, f, x, m in rows if i < j and g == f and (d := ((h ^ x) & k & m).bit_count()) <= radius)
        assert sorted(map(tuple, curate.row_pairs(df, "g", "id", "h", radius, block, known="known").collect())) == want
    every = sorted((g, i, j, d) for i, g, h, _ in rows for j, f, x, _ in rows if i < j and g == f and (d := (h ^ x).bit_count()) <= 5)
    assert sorted(map(tuple, curate.row_pairs(df, "g", "id", "h", 5, 16).collect())) == every
