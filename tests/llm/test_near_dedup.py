import random

import pytest

import corpus_pipeline
from freqloom.llm.near_dedup import Member, local_links, near_dedup, rarest, shingle_set, similar
from freqloom.llm.simhash import majority

from .helpers import awkward, docs, empty


def brute_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(texts):
    """Positions that are the least of their component of pairs with a Jaccard similarity of 0.8 or more."""
    sets, top = [brute_set(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if top[i] != top[j] and (sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])):
                a, b = max(top[i], top[j]), min(top[i], top[j])
                top = [b if x == a else x for x in top]
    return sorted(set(top))


def near_copies():
    random.seed(11)
    base = [[f"w{random.randint(0, 9999)}" for _ in range(random.randint(6, 300))] for _ in range(25)]
    texts = []
    for _ in range(200):
        words = list(random.choice(base))
        for _ in range(random.choice([0, 1, 1, 2, 3, 5, 8])):
            words[random.randrange(len(words))] = f"changed{random.random()}"
        texts.append(" ".join(words))
    return texts + ["", None, " ", "one", "ONE", "two words"]


@pytest.mark.parametrize("tree, pivots", ((1024, 64), (3, 64), (3, 1)))
def test_kept_equal_brute_force(spark, tree, pivots):
    texts = near_copies()
    want = brute_kept(texts)
    assert 30 < len(want) < 180
    assert sorted(r.doc_id for r in near_dedup(docs(spark, texts), tree=tree, pivots=pivots).collect()) == want


def members(texts, asks=()):
    sets = [shingle_set(t.encode()) for t in texts]
    return [Member(majority(x) % (1 << 64), k, k, k not in asks, x.view("int64")) for k, x in enumerate(sets)]


def parts(pairs, n):
    top = list(range(n))
    for a, b in pairs:
        top = [top[b] if x == top[a] else x for x in top]
    return {frozenset(k for k in range(n) if top[k] == t) for t in top}


def test_links_of_a_tile():
    texts = [t for t in dict.fromkeys(near_copies()) if t and t.strip()]
    found = members(texts)
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if similar(found[a].hashes, found[b].hashes)]
    got = list(local_links(found, 22))
    assert parts(got, len(texts)) == parts(pairs, len(texts)) and set(got) <= {(a, b) for p in pairs for a, b in (p, p[::-1])}
    assert len(got) == len(texts) - len(parts(pairs, len(texts)))  # a link joins two components
    asks = set(range(0, len(texts), 3))
    got = list(local_links(members(texts, asks), 22))
    assert parts(got, len(texts)) == parts([(a, b) for a, b in pairs if (a in asks) != (b in asks)], len(texts))


def test_similar_sets_share_a_rarest_shingle():
    texts = [t for t in dict.fromkeys(near_copies()) if t and t.strip()]
    found = members(texts)
    rare = [set(x) for x in rarest(found)]
    assert all(rare[a] & rare[b] for a in range(len(texts)) for b in range(a) if similar(found[a].hashes, found[b].hashes))
    assert sum(not (rare[a] & rare[b]) for a in range(len(texts)) for b in range(a)) > len(texts) ** 2 / 3


def test_many_copies_are_not_compared_pair_by_pair(spark, monkeypatch):
    from freqloom.llm import near_dedup as N

    random.seed(4)
    words = [f"w{k}" for k in range(200)]
    texts = [" ".join(words[:k] + [f"changed{k}"] + words[k + 1 :]) for k in range(150)]
    texts += [" ".join(f"other{k}" if random.random() < 0.12 else w for w in words) for k in range(60)]  # alike, but not enough
    calls, real = [], N.similar
    monkeypatch.setattr(N, "similar", lambda a, b: calls.append(1) or real(a, b))
    assert len(list(local_links(members(texts), 22))) == 149 and len(calls) < 1500
    assert len(near_dedup(docs(spark, texts)).collect()) == 61


def test_pipeline_leaves_no_near_copies(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, sf_dir)
    texts = [r.text for r in rows.collect()]
    assert brute_kept(texts) == list(range(len(texts)))


def test_odd_rows(spark):
    kept = near_dedup(awkward(spark))
    assert kept.columns == awkward(spark).columns
    rows = kept.collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [1, 3, 4, 6, 7] and len(rows) == 6
    assert near_dedup(empty(spark)).count() == 0


def test_rows_of_one_id_with_unlike_texts_both_stay(spark):
    from pyspark.sql import functions as F

    rows = [(1, "a text about one thing"), (1, "quite another text than that"), (1, "A text about one thing"), (2, "quite another text than that"), (1, "a text about one thing")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("__id", "__nth", "__digest", "node", "id")})
    got = near_dedup(df)
    assert got.columns == df.columns and {r["__id"] for r in got.collect()} == {"mine"}
    found = sorted((r.doc_id, r.text.lower()) for r in got.collect())
    assert found == [(1, "a text about one thing"), (1, "quite another text than that")]
