from itertools import combinations

from hypothesis import given, settings
from hypothesis import strategies as st

from freqloom.llm.packing import optimal_buckets, pack, pack_documents

from .helpers import ROWS, awkward, empty


def padding(hist, bounds):
    return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in hist.items())


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(0, 30), st.integers(1, 9), min_size=1, max_size=8), st.integers(1, 4))
def test_buckets_are_optimal(hist, k):
    bounds = optimal_buckets(list(hist), list(hist.values()), k)
    assert bounds == sorted(set(bounds)) and len(bounds) <= k and bounds[-1] == max(hist)
    top = max(hist)
    best = min(padding(hist, [*c, top]) for r in range(k) for c in combinations(sorted(set(hist) - {top}), r))
    assert padding(hist, bounds) == best


def test_no_lengths():
    assert optimal_buckets([], [], 3) == []


def test_whole_documents_within_budget(spark):
    lengths = [(i, (i * 37) % 90) for i in range(400)] + [(400, None), (401, 1000), (401, 1000), (None, 5)]
    rows = spark.createDataFrame(lengths, "doc_id long, n_tokens long")
    got = pack(rows, max_len=64, buckets=4, budget=256, shard_rows=50).collect()
    total = {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
        assert 0 <= r.n_tokens <= r.bucket <= 64
    want = {}
    for i, n in lengths:
        want[i] = want.get(i, 0) + (n or 0)
    assert total == want
    batches = {}
    for r in got:
        batches.setdefault((r.bucket, r.shard, r.batch), []).append(r)
    assert all(len(v) == v[0].batch_rows and len(v) * max(1, k[0]) <= max(256, k[0]) or len(v) <= 256 for k, v in batches.items())
    assert len({r.bucket for r in got}) <= 4


def test_batches_equal_brute_force(spark):
    """Each shard's segments in order of id, number and ids, cut into batches of the budget."""
    texts = {k: bytes(range(1, 1 + (k * 37) % 90)) for k in range(300)}
    rows = spark.createDataFrame([(k, len(x), 1, bytearray(x)) for k, x in texts.items()], "doc_id long, n_tokens long, width int, ids binary")
    got = pack(rows, max_len=32, buckets=3, budget=256, shard_rows=60).collect()
    pieces = [(k, j, x[j * 32 : j * 32 + 32]) for k, x in texts.items() for j in range(max(1, -(-len(x) // 32)))]
    assert sorted((r.doc_id, r.segment, bytes(r.ids)) for r in got) == sorted(pieces)
    bounds = optimal_buckets(*zip(*{n: sum(len(p[2]) == n for p in pieces) for n in {len(p[2]) for p in pieces}}.items()), 3)
    held = {}
    for r in got:
        assert r.bucket == min(b for b in bounds if b >= r.n_tokens == len(r.ids))
        held.setdefault((r.bucket, r.shard), []).append((r.doc_id, r.segment, bytes(r.ids), r.batch, r.batch_rows))
    for (bucket, _), found in held.items():
        fits, found = max(1, 256 // bucket), sorted(found)
        assert [x[3] for x in found] == [k // fits for k in range(len(found))]
        assert [x[4] for x in found] == [min(fits, len(found) - k // fits * fits) for k in range(len(found))]


def test_awkward_rows(spark):
    import public_tokenizers as P

    from .test_records import packed

    file = P.path("word_bpe_49k.json")
    got = sorted(pack_documents(awkward(spark), file).collect(), key=lambda r: (str(r.doc_id), r.segment))
    for i, t, *_ in ROWS:
        if i != 5:
            assert b"".join(bytes(r.ids) for r in got if r.doc_id == i) == packed(t) + b"\1\0"
    assert sum(r.doc_id == 5 for r in got) == 2  # repeated rows are both packed
    assert pack_documents(empty(spark), file).count() == 0
