"""Behaviours that matter, each on a tiny table."""

import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from freqloom.functions import stats as S
from freqloom.functions import text as T
from freqloom.functions import vectors as V
from freqloom.operators import curate, evaluate, generated, index, search

few = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
WORDS = ["dog", "cat", "red", "car", "tree"]


def corpus(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "sample_id long, text string")


def concepts(spark, names):
    return spark.createDataFrame(list(enumerate(names)), "concept_id long, concept string")


def hits(df):
    return {(r.concept, r.sample_id) for r in df.collect()}


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_unknown_terms_are_dropped_and_all_unknown_is_nothing(spark):
    docs = corpus(spark, ["A dog and a cat", "dog", None, ""])
    asked = concepts(spark, ["dog zzz", "zzz", "Dog_cat", "_dog"])
    want = {("dog zzz", 0), ("dog zzz", 1), ("Dog_cat", 0), ("_dog", 0), ("_dog", 1)}
    assert hits(search.text_search(docs, asked)) == want
    assert hits(search.text_search_postings(index.unigram_postings(docs), asked)) == want


def test_search_without_any_known_term_is_empty(spark):
    assert hits(search.text_search(corpus(spark, ["dog"]), concepts(spark, ["zzz"]))) == set()


@few
@given(st.lists(st.lists(st.sampled_from(WORDS), max_size=6).map(" ".join), min_size=1, max_size=8))
def test_both_search_plans_agree_and_and_narrows(spark, texts):
    docs, asked = corpus(spark, texts), concepts(spark, ["dog", "cat", "dog cat"])
    a = hits(search.text_search(docs, asked))
    assert a == hits(search.text_search_postings(index.unigram_postings(docs), asked))
    held = {w for t in texts for w in t.split()}
    if {"dog", "cat"} <= held:
        assert {s for c, s in a if c == "dog cat"} == {s for c, s in a if c == "dog"} & {s for c, s in a if c == "cat"}


def test_postings_are_distinct(spark):
    assert index.doc_freq(index.unigram_postings(corpus(spark, ["dog dog", "dog"]))).first().df == 2


def test_threshold_is_strict_and_zero_concepts_stay(spark):
    probs = spark.createDataFrame([(0, 0, 0.6), (1, 0, 0.7), (2, 0, 0.600001)], "sample_id long, concept_id long, prob double")
    found = index.with_empty(concepts(spark, ["a", "b"]), index.image_postings(probs, [0.6, 0.5]), [0.6, 0.5])
    assert {(r.threshold, r.concept): r.n for r in found.collect()} == {(0.6, "a"): 2, (0.6, "b"): 0, (0.5, "a"): 3, (0.5, "b"): 0}


@pytest.mark.parametrize("chunks", [1, 2, 5])
def test_chunks_do_not_change_the_merged_index(spark, chunks):
    texts = ["dog cat", "cat", "red dog", "tree", "dog"]
    size = len(texts) // chunks + 1
    rows = [(i // size, i % size, w) for i, t in enumerate(texts) for w in t.split()]
    sizes = {}
    for i in range(len(texts)):
        sizes[i // size] = sizes.get(i // size, 0) + 1
    merged = index.merge_chunks(spark.createDataFrame(rows, "chunk_id long, local_id long, term string"), spark.createDataFrame(list(sizes.items()), "chunk_id long, n long"))
    assert {tuple(r) for r in merged.collect()} == {(w, i) for i, t in enumerate(texts) for w in t.split()}


def test_last_duplicate_caption_wins(spark):
    shard = spark.createDataFrame([(7, "a"), (8, "b"), (9, "none")], "sample_id long, text string")
    rows = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "row_id long, text string")
    assert {tuple(r) for r in index.remap_by_caption(shard, rows).collect()} == {(7, 2), (8, 1)}


def test_misalignment(spark):
    t = spark.createDataFrame([(0, 1), (1, 1), (2, 1)], "sample_id long, concept_id long")
    i = spark.createDataFrame([(0, 1), (1, 2), (3, 1)], "sample_id long, concept_id long")
    r = search.misalignment(t, i, spark.createDataFrame([(10,)], "n long")).first()
    assert (r.n_mis, r.degree_extracted, r.degree_fixed) == (1, round(1 / 3, 6), 0.1)


def test_case_variants(spark):
    assert one(spark, T.case_variants(F.lit("hot air"))) == ["hot_air", "hot_Air", "Hot_air", "Hot_Air"]


def test_plural_rule_is_a_prefix_test(spark):
    found = [one(spark, T.mentions(F.lit(p), F.lit("word"))) for p in ("A word.", "the words!", "a wordsmith", "sword", "wordy")]
    assert found == [True, True, True, False, False]


def test_article(spark):
    assert one(spark, T.with_article(F.lit("Apple/pear_tree..."))) == "This is an apple or pear tree."


@given(st.lists(st.floats(0.5, 50), min_size=2, max_size=12), st.floats(0.1, 60))
@few
def test_digitize_equals_numpy(spark, edges, x):
    edges = sorted(edges)
    assert one(spark, S.digitize(F.lit(x), F.lit(edges))) == int(np.digitize([x], edges, right=True)[0])


def test_log_bins_keeps_empty_bins_and_the_minimum_in_bin_zero(spark):
    rows = spark.createDataFrame([(0, 1.0), (1, 3.0), (100, 5.0)], "n long, v double")
    got = {r.bin: (r.n, r.mean, r.std) for r in S.log_bins(rows, "n", "v", 5).collect()}
    assert got[0] == (2, 2.0, 1.0) and got[4] == (1, 5.0, 0.0) and got[2] == (0, 0.0, 0.0) and len(got) == 5
    assert S.log_bins(rows.limit(0), "n", "v", 5).count() == 0


def test_pearson_p_value():
    # Two-sided p of known t statistics.
    assert abs(S.pearson_p(0.6, 10) - 0.06668) < 1e-4
    assert abs(S.pearson_p(-0.9, 12) - 6.5e-5) < 1e-5
    assert S.pearson_p(1.0, 5) == 0 and math.isnan(S.pearson_p(0.5, 2))
    assert abs(S.pearson_p(0.0, 20) - 1) < 1e-12


def test_tags_found_without_making_variants(spark):
    concepts = ["hot air", "a b", "_", "many words " * 20, "x  y", "one", None, "p q"]
    tags = ["hot_Air", "Hot_air", "hot air", "A b", "a B", "", "MANY_words_" * 19 + "many_Words", "many_words_" * 19 + "Many_words", "X_y", "x y", "ONE", "One", "p q", "P_q", "p_Q"]
    c = spark.createDataFrame(list(enumerate(concepts)), "concept_id long, concept string")
    t = spark.createDataFrame([(x,) for x in tags], "tag string")
    want = {0: "hot air", 1: "A b", 2: "", 3: "many_words_" * 19 + "Many_words", 4: "X_y", 5: "One", 6: None, 7: "p q"}
    assert {r.concept_id: r.tag for r in search.tag_of(c, t).collect()} == want


def test_log_bins_of_groups(spark):
    rows = spark.createDataFrame([(g, n * (g + 1), float(n % 7)) for g in range(3) for n in range(1, 60)], "g long, n long, v double")
    got = {(r.g, r.bin): (r.edge, r.n, r.mean, r.std) for r in S.log_bins(rows, "n", "v", 6, ["g"]).collect()}
    for g in range(3):
        for r in S.log_bins(rows.where(F.col("g") == g), "n", "v", 6).collect():
            assert got.pop((g, r.bin)) == pytest.approx((r.edge, r.n, r.mean, r.std))
    assert not got


def test_average_rank(spark):
    rows = spark.createDataFrame([("a", 3), ("b", 1), ("c", 3), ("d", 9)], "k string, v long")
    want = {("a", 2.5), ("b", 1.0), ("c", 2.5), ("d", 4.0)}
    assert {tuple(r) for r in S.rank_by_value(rows, "k", "v", "r").collect()} == want
    assert {tuple(r) for r in rows.select("k", S.average_rank(F.col("v"))).collect()} == want


def test_buckets_close_on_a_drop_or_at_size(spark):
    freq = spark.createDataFrame([(9,)] * 3 + [(8,)] * 2 + [(5,)] * 8 + [(0,)] * 4, "df long")
    got = [tuple(r) for r in curate.quantile_buckets(freq, size=6, least=3).orderBy("bucket").collect()]
    assert got == [(0, 3, 9, 9), (1, 6, 5, 8)]  # two of 8 and four of 5; the last four stay open


def brute_buckets(counts, size, least):
    out, held = [], []
    for v in sorted((x for x in counts if x > 0), reverse=True):
        if held and v < held[-1] and len(held) >= least:
            out.append(held)
            held = []
        held.append(v)
        if len(held) == size:
            out.append(held)
            held = []
    return [(i, len(b), b[-1], b[0]) for i, b in enumerate(out)]


@pytest.mark.parametrize("size, least, seed", [(6, 3, 1), (10, 1, 2), (25, 25, 3), (7, 5, 4), (50, 20, 5)])
def test_buckets_fold_alike_over_partitions(spark, size, least, seed):
    rng = random.Random(seed)
    counts = [int(rng.paretovariate(0.6)) % 400 for _ in range(900)]
    freq = spark.createDataFrame([(c,) for c in counts], "df long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = curate.quantile_buckets(freq, size=size, least=least).orderBy("bucket").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [tuple(r) for r in found] == brute_buckets(counts, size, least)


def test_buckets_of_nothing(spark):
    freq = spark.createDataFrame([(0,)], "df long")
    assert curate.quantile_buckets(freq).collect() == []


def brute_greedy(bits, radius):
    gone = set()
    for i in range(len(bits)):
        if i not in gone:
            gone |= {j for j in range(len(bits)) if j != i and (bits[i] ^ bits[j]).bit_count() <= radius}
    return set(range(len(bits))) - gone


@few
@given(st.lists(st.integers(0, 255), min_size=1, max_size=14))
def test_greedy_survivors_equal_the_sequential_choice(spark, bits):
    rows = spark.createDataFrame([(0, i, b) for i, b in enumerate(bits)], "label long, id long, bits long")
    pairs = curate.hash_pairs(rows, "label", "id", "bits", radius=2)
    first = [bits.index(b) for b in dict.fromkeys(bits)]  # copies are one class
    assert {(r.a, r.b) for r in pairs.collect()} == {(i, j) for i in first for j in first if i < j and (bits[i] ^ bits[j]).bit_count() <= 2}
    classes = curate.representatives(rows, "label", "id", "bits")
    assert {r.id for r in curate.greedy_survivors(classes, pairs, "label", "id").collect()} == brute_greedy(bits, 2)


def test_banded_pairs_find_all_up_to_ten_bits(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 20)]
    bits = base + [b ^ sum(1 << int(k) for k in rng.choice(63, int(n), replace=False)) for b in base for n in (1, 10, 11)]
    rows = spark.createDataFrame([(0, i, b) for i, b in enumerate(bits)], "label long, id long, bits long")
    want = {(i, j) for i in range(len(bits)) for j in range(i + 1, len(bits)) if ((bits[i] ^ bits[j]) & (2**64 - 1)).bit_count() <= 10}
    assert {(r.a, r.b) for r in curate.hash_pairs(rows, "label", "id", "bits").collect()} == want


def test_class_balance_needs_more_than_the_least(spark):
    rows = spark.createDataFrame([("a", i) for i in range(6)] + [("b", i) for i in range(5)], "label string, id long")
    kept = curate.balance(rows, "label", [F.md5(F.col("id").cast("string"))], 5, 5)
    assert kept.groupBy("label").count().collect()[0][:] == ("a", 5)


def test_recall_ranks_equal_full_sort(spark):
    rng = np.random.default_rng(0)
    t, i = rng.normal(size=(30, 8)), rng.normal(size=(6, 8))
    q = spark.createDataFrame([(k, k // 5, t[k].tolist()) for k in range(30)], "query_id long, own_id long, v array<double>")
    c = spark.createDataFrame([(k, k, i[k].tolist()) for k in range(6)], "cand_id long, own_id long, v array<double>")
    got = {r.query_id: r["rank"] for r in evaluate.true_ranks(q, c).collect()}
    assert got == {k: int((-(t[k] @ i.T)).argsort().tolist().index(k // 5)) + 1 for k in range(30)}
    r = {x.k: x.recall for x in evaluate.recall(evaluate.true_ranks(q, c)).collect()}
    assert r[1] <= r[5] <= r[10] == 100


def test_average_precision(spark):
    rows = spark.createDataFrame([(0, 1, 0.9, 1), (0, 2, 0.8, 0), (0, 3, 0.7, 1), (1, 1, 0.5, 0)], "label long, id long, score double, hit int")
    got = {r.label: r.ap for r in evaluate.average_precision(rows, "label").collect()}
    assert abs(got[0] - (1 + 2 / 3) / 2) < 1e-6 and got[1] == 0


def test_generated_scores(spark):
    rows = spark.createDataFrame([("m", "a", 1.0), ("m", "a", 3.0), ("m", "b", None)], "model string, concept string, score double")
    got = {(r.concept, r["mean"], r.n) for r in generated.aggregate(rows, ["model"], "concept", "score").collect()}
    assert got == {("a", 2.0, 2), ("b", 0.0, 0), (None, 2.0, 2)}


def test_vector_functions(spark):
    a, b = F.lit([3.0, 4.0]), F.lit([1.0, 2.0])
    assert one(spark, V.dot(a, b)) == 11 and one(spark, V.norm(a)) == 5
    assert one(spark, V.unit(a)) == [0.6, 0.8]
    assert one(spark, V.sign_bits(F.lit([1.0, -1.0, 2.0]))) == 0b101
    assert one(spark, V.hamming(F.lit(5), F.lit(6))) == 2


def test_concepts_of_more_terms_than_a_mask_has_bits(spark):
    words = ["".join(chr(97 + int(c)) for c in str(k)) + "x" for k in range(70)]
    docs, asked = corpus(spark, [" ".join(words), " ".join(words[:-1])]), concepts(spark, [" ".join(words), words[0]])
    assert hits(search.text_search(docs, asked)) == {(" ".join(words), 0), (words[0], 0), (words[0], 1)}


def test_tags_are_found_under_other_spellings(spark):
    asked = concepts(spark, ["hot dog", "Hot_Dog", "tree", "old TREE", "none", "red car"])
    tags = spark.createDataFrame([(x,) for x in ("hot_Dog", "Hot_Dog", "TREE", "OLD_tree", "old tree", "red car", "Red_Car")], "tag string")
    got = {r.concept: r.tag for r in search.tag_of(asked, tags).collect()}
    assert got == {"hot dog": "hot_Dog", "Hot_Dog": "Hot_Dog", "tree": "TREE", "old TREE": "OLD_tree", "none": None, "red car": "red car"}
    postings = spark.createDataFrame([("Red_Car", 1), ("red car", 2)], "tag string, sample_id long")
    assert hits(search.tagged_hits(postings, asked)) == {("red car", 2)}


def test_cased_terms(spark):
    assert one(spark, index.cased(F.lit("The dog's Tail"))) == ["The", "dog", "s", "Tail"]


def test_class_blocks_and_ties(spark, monkeypatch):
    vectors = spark.createDataFrame([(k, k % 3, [float(k), 1.0]) for k in range(7)], "vec_id long, label int, embedding array<double>")
    classes = spark.createDataFrame([(k, [0.5 * (k % 2), float(k // 2)]) for k in range(6)], "label int, proto array<double>")
    want = {(v, c): v * 0.5 * (c % 2) + c // 2 for v in range(7) for c in range(6)}
    best = {v: min(range(6), key=lambda c: (-want[v, c], c)) for v in range(7)}
    for block in (2048, 2):
        monkeypatch.setattr(evaluate, "BLOCK", block)
        assert {(r.vec_id, r.label): r.sim for r in evaluate.class_similarity(vectors, classes, "vec_id").collect()} == want
        assert {r.vec_id: r.label for r in evaluate.best_class(vectors, classes, "vec_id").collect()} == best


def test_top_k_in_tiles(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=4).tolist()) for k in range(60)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(evaluate, "BLOCK", 7)
    got = {(r.q, r["rank"]): r.cand for r in evaluate.top_k(v.where("vec_id % 5 = 0"), v, 3).collect()}
    m = np.array([x for _, x in rows])
    want = {(q, n + 1): c for q in range(0, 60, 5) for n, c in enumerate(sorted((c for c in range(60) if c != q), key=lambda c: (-round(float(m[q] @ m[c]), 9), c))[:3])}
    assert got == want


def test_average_precision_over_partitions(spark):
    rng = np.random.default_rng(6)
    rows = [(int(g), k, float(s), int(h)) for k, (g, s, h) in enumerate(zip(rng.integers(0, 3, 500), rng.integers(0, 9, 500), rng.integers(0, 2, 500)))]
    got = {r.g: r.ap for r in evaluate.average_precision(spark.createDataFrame(rows, "g long, id long, score double, hit int"), "g").collect()}
    for g in range(3):
        found = [h for _, _, _, h in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], -r[1]))]
        want = sum(h * sum(found[: k + 1]) / (k + 1) for k, h in enumerate(found)) / (sum(found) + 1e-8)
        assert abs(got[g] - want) < 1e-12


def test_copies_are_one_class(spark):
    rows = spark.createDataFrame([(k, 0, k // 50) for k in range(150)] + [(900, 1, 0)], "id long, g int, h long")
    assert {(r.a, r.b, r.dist) for r in curate.hash_pairs(rows, "g", "id", "h").collect()} == {(0, 50, 1), (0, 100, 1), (50, 100, 2)}
    assert {(r.id, r.rep) for r in curate.copies_of(rows, "g", "id", "h").collect()} == {(k, k // 50 * 50) for k in range(150)} | {(900, 900)}
    assert {r.id: r.copies for r in curate.representatives(rows, "g", "id", "h").collect()} == {0: 50, 50: 50, 100: 50, 900: 1}


def test_hashes_of_more_than_64_signs_are_an_error(spark):
    assert one(spark, V.sign_bits(F.lit([1.0] * 64))) == -1
    with pytest.raises(Exception, match="64 signs"):
        one(spark, V.sign_bits(F.lit([1.0] * 65)))


def test_p_values(spark):
    got = S.with_p(spark.createDataFrame([(0.5, 12), (None, 12)], "r double, n int"), "r", "n").collect()
    assert abs(got[0].p - 0.0978) < 1e-3 and got[1].p is None


def test_bucket_answers_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    counts = {k: int(n) for k, n in enumerate(rng.integers(0, 12, 200))}
    answers = [(int(k), int(a)) for k, a in zip(rng.integers(0, 200, 900), rng.integers(0, 2, 900))]
    got = curate.bucket_answers(spark.createDataFrame(list(counts.items()), "id long, n long"), spark.createDataFrame(answers, "id long, answer int"), "id", "n", most=4, size=30, least=10).collect()
    buckets, held = [], []
    for k in sorted((k for k in counts if counts[k]), key=lambda k: (-counts[k], k)):
        if held and counts[k] < counts[held[-1]] and len(held) >= 10:
            buckets.append(held)
            held = []
        held.append(k)
        if len(held) == 30:
            buckets.append(held)
            held = []
    for b, held in enumerate(buckets[:4]):
        own = [a for k, a in answers if k in held]
        r = next(r for r in got if r.bucket == b)
        assert (r.n, r.lo, r.hi, r.answers) == (len(held), counts[held[-1]], counts[held[0]], len(own)) and abs(r.mean - np.mean(own)) < 1e-12
    assert len(got) == 4


def test_prompts_tasks_and_score_rows(spark):
    text = '[{"id": "a", "input": {"text": "a dog"}}, {"id": "b", "input": {"text": "x"}}, {"id": "a", "input": {"text": "later"}}]'
    got = {r.id: r.prompt for r in generated.read_prompts(spark.createDataFrame([(text,)], "j string"), "j").collect()}
    assert got == {"a": "a dog", "b": "x"}
    assert [one(spark, generated.task_name(F.lit(x))) for x in ("runs/sdxl_human_aesthetics.json", "x_exp_clip.tar.json", "plain.json")] == ["human_aesthetics", "exp_clip", "plain"]
    c = spark.createDataFrame([("cat", 0), ("cat", 9), ("dog", 9)], "concept string, idx long")
    got = {(r.concept, r.idx): r.scores for r in generated.score_rows(c, spark.createDataFrame([(0, [1.0, 2.0])], "idx long, scores array<double>")).collect()}
    assert got == {("cat", 0): [1.0, 2.0], ("cat", 9): None, ("dog", 9): None}


def test_concept_maps(spark):
    rows = [(k, p, t) for k in range(3) for p, t in enumerate(["a dog", "dogs and cats" if k else "sun"])]
    maps = index.concept_maps(spark.createDataFrame(rows, "img long, pos int, caption string"), "img", "pos", "caption", least=2)
    assert {tuple(r) for r in maps["images"][0].select("img", "concept").collect()} == {(0, "dog"), (1, "dog"), (2, "dog"), (1, "cat"), (2, "cat")}
    assert {tuple(r) for r in maps["captions"][0].select("img", "pos", "concept").collect()} == {(k, 0, "dog") for k in range(3)} | {(k, 1, c) for k in (1, 2) for c in ("dog", "cat")}
    assert maps["captions"][1].count() == 6 and maps["images"][1].count() == 3
