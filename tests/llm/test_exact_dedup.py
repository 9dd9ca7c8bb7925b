import hashlib
import random

from freqloom.llm.exact_dedup import exact_dedup

from .helpers import ROWS, awkward, docs, empty


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    return {t: (max((i for i in g if i is not None), default=None), len(g)) for t, g in groups.items()}


def test_awkward_rows(spark):
    got = exact_dedup(awkward(spark)).collect()
    want = brute([r[:2] for r in ROWS])
    assert len(got) == len(ROWS)
    by = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in want.items()}
    assert all((r.keep_id, r.group_size) == by[r.text_sha256] for r in got)
    assert sum(r.kept for r in got) == len(want)  # of repeated rows one stays
    assert exact_dedup(empty(spark)).count() == 0


def test_heavy_and_light_digests_agree_with_brute_force(spark):
    random.seed(4)
    texts = [random.choice(["hot", "HOT", "warm", *[str(k) for k in range(60)]]) if random.random() < 0.7 else "hot" for _ in range(600)]
    got = {r.doc_id: r for r in exact_dedup(docs(spark, texts), slots=8, tracked=256).collect()}
    want = brute(list(enumerate(texts)))
    assert all((got[i].keep_id, got[i].group_size) == want[lower(t)] and got[i].kept == (i == want[lower(t)][0]) for i, t in enumerate(texts))
