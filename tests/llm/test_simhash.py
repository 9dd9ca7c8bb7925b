import random

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from freqloom.llm.components import components
from freqloom.llm.simhash import BKTree, fingerprint, fingerprints, grouped, links, shards, tile_links, tiled

from .helpers import ROWS, awkward, docs, empty

BLANK = " \t\n\x0b\x0c\r"


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for b in BLANK:
        text = text.replace(b, " ")
    words = [w for w in text.split(" ") if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, radius=3):
    top = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius and top[i] != top[j]:
                a, b = max(top[i], top[j]), min(top[i], top[j])
                top = [b if x == a else x for x in top]
    return top


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aAbÉ \t\n\x0b\x1c 'z", max_size=60))
def test_fingerprint_equals_brute_force(text):
    assert fingerprint(text.encode()) % (1 << 64) == brute_fingerprint(text)


def test_long_text_is_counted_in_chunks():
    text = " ".join(random.choice("abcdefgh") for _ in range(70_000))
    assert fingerprint(text.encode()) % (1 << 64) == brute_fingerprint(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2**10 - 1), min_size=1, max_size=40, unique=True), st.integers(0, 4))
def test_tree_search_finds_all_within_the_radius(values, radius):
    tree = BKTree()
    for v in values:
        tree.add(v)
        tree.add(v)
    for q in range(0, 1024, 37):
        assert sorted(tree.near(q, radius)) == sorted(v for v in values if (v ^ q).bit_count() <= radius)


def test_tile_of_two_sides():
    assert dict(tile_links([0b1, 0xFF00], [0b111, 0xF0000], 3)) == {0b111: 0b1}


def clustered(n=120):
    random.seed(9)
    out = []
    while len(out) < n:
        base = random.getrandbits(64)
        for _ in range(random.randint(1, 12)):
            out.append(base)
            for b in random.sample(range(64), random.randint(1, 4)):
                base ^= 1 << b
    return list(dict.fromkeys(out))


def test_links_and_components_equal_brute_force(spark):
    values = sorted(x - (1 << 64) if x >> 63 else x for x in clustered())
    want = brute_components([v % (1 << 64) for v in values])
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    for tree in (4096, 3):  # whole shards, and shards cut into many tiles
        found = {r.a: r.b for r in components(links(df, tree=tree)).collect()}
        assert [found.get(v, v) for v in values] == [values[t] for t in want]


def test_components_of_a_chain_and_a_star(spark):
    chain = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(5, 5), (200, 201), (201, 200)]
    random.shuffle(chain)
    got = {r.a: r.b for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {k: 100 for k in range(101, 140)} | {201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents_equal_brute_force(spark):
    random.seed(8)
    base = [" ".join(f"w{random.randint(0, 999)}" for _ in range(300)) for _ in range(12)]
    texts = []
    for _ in range(90):
        words = random.choice(base).split()
        for _ in range(random.choice([0, 0, 1, 3, 40])):
            words[random.randrange(300)] = "changed"
        texts.append(" ".join(words))
    texts += ["", None, " ", "one", "ONE", "two words"] + ["hot copy of a text"] * 40
    want = brute_components([brute_fingerprint(t) for t in texts])
    got = {r.doc_id: r for r in grouped(docs(spark, texts), tree=4).collect()}
    for k, t in enumerate(texts):
        assert got[k].fingerprint == f"{brute_fingerprint(t):016x}" and got[k].component_id == want[k]


def test_awkward_rows(spark):
    got = grouped(awkward(spark)).collect()
    assert len(got) == len(ROWS)
    assert {(r.component_id) for r in got if r.doc_id in (1, 2, 8)} == {1} and {r.component_id for r in got if r.doc_id in (3, 5)} == {3}
    assert next(r for r in got if r.doc_id is None).component_id is None
    assert fingerprints(empty(spark)).count() == 0 and grouped(empty(spark)).count() == 0


def test_three_bits_share_a_shard(spark):
    random.seed(13)
    pairs = [(x, x ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 3)))) for x in (random.getrandbits(64) for _ in range(200))]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x), signed(y)) for x, y in pairs], "x long, y long")
    both = df.select(shards_of(F.col("x")).alias("a"), shards_of(F.col("y")).alias("b"))
    assert both.where(F.size("a") != 20).count() == 0 and both.where(F.size(F.array_intersect("a", "b")) == 0).count() == 0


def shards_of(fp):
    return F.transform(F.array(fp), lambda fp: shards(fp))[0]


def test_tiles_of_a_fingerprint_do_not_grow(spark):
    """Ten times as many unlike fingerprints meet no more others each."""
    met = []
    for n in (3_000, 30_000):
        placed = spark.range(n).select(F.xxhash64("id").alias("fp")).select("fp", F.explode(shards(F.col("fp"))).alias("shard"))
        held = placed.groupBy("shard").count()
        met.append(held.agg(F.sum(F.expr("count * (count - 1)"))).first()[0] / n)
    assert met[1] < 0.01 and met[0] < 0.01


def test_tiles_of_a_shard_hold_every_pair_once(spark):
    rows = [(k, 5, 4) for k in range(40)]
    tiles = tiled(spark.createDataFrame(rows, "fp long, shard long, parts int")).collect()
    met = {}
    for r in tiles:
        met.setdefault((r.i, r.j), ([], []))[r.holds].append(r.fp)
    pairs = [frozenset((x, y)) for (i, j), (ask, hold) in met.items() for x in hold for y in (hold if i == j else ask) if x < y or i != j]
    assert len(pairs) == len(set(pairs)) == 40 * 39 // 2
