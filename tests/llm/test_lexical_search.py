import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from freqloom.llm import lexical_search as L

from .helpers import LONG, awkward, empty

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id long, text string"


def cut_up(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=20):
    held = [(i, Counter(cut_up(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 100 - 25 + (25 * c.total() * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in cut_up(text) if t in c)
            if score > 0:
                scores.append((-score, i is not None, i or 0, i))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scores, key=lambda x: x[:3])[:top])]
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def invented(seed, n=400):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["É", "ß2", "The", "x-y", "a\x00b", "日本"]
    weights = [1 / (k + 1) for k in range(len(words))]
    text = lambda most: " ".join(rng.choices(words, weights, k=rng.randint(0, most)))
    docs = [(k, rng.choice([None, text(5), text(80), "the"])) for k in range(n)] + [(3, "w1 w2"), (3, "w1 w2"), (None, "w1 w5")]
    return docs, [(k, text(12)) for k in range(30)] + [(30, None), (31, ""), (32, "nowhere"), (33, "the The w1 w1")]


@pytest.mark.parametrize("block_terms", [L.BLOCK_TERMS, 40])
def test_equals_brute_force_in_one_block_and_in_many(spark, block_terms):
    docs, items = invented(5)
    got = L.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, ITEMS), block_terms=block_terms)
    assert result(got) == brute(docs, items)


def test_small_chunks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(L, "CHUNK", 100)
    docs, items = invented(6)
    assert result(L.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS))) == brute(docs, items)


def test_awkward_rows(spark):
    items = [(1, "word words five"), (None, "école çà ROW"), (2, LONG), (3, "one")]
    rows = [(r[0], r[1]) for r in awkward(spark).select("doc_id", "text").collect()]
    got = L.search(awkward(spark), spark.createDataFrame([(*x, "clash", "clash") for x in items], ITEMS + ", item string, doc string"))
    assert result(got) == brute(rows, items)
    assert L.search(empty(spark), spark.createDataFrame(items, ITEMS)).count() == 0
    assert L.search(awkward(spark), spark.createDataFrame([], ITEMS)).count() == 0
    assert result(L.search(awkward(spark), spark.createDataFrame([(7, "one"), (7, "zzz"), (7, "one")], ITEMS))) == brute(rows, [(7, "one")])


def test_radix_order_is_a_stable_sort():
    rng = np.random.default_rng(2)
    for bits in (3, 16, 17, 40):
        keys = rng.integers(0, 1 << bits, 5000)
        keys[::3] = keys[0]
        assert (L.radix_order(keys, bits) == np.argsort(keys, kind="stable")).all()


def test_query_equals_sql(spark, sf_dir):
    from freqloom.llm import queries

    from ..oracle import assert_same, connect

    assert_same(queries.queries()["op13_lexical_search"](spark, sf_dir), connect(sf_dir), queries.oracle_sql()["op13_lexical_search"])
