from freqloom.llm import style_tree as S


def test_every_word_of_a_long_branch_is_counted(spark):
    text = " ".join(f"w{chr(97 + a)}{chr(97 + b)}" for a in range(20) for b in range(10))
    pages = spark.createDataFrame([("h", 0, [(5, text)]), ("h", 0, [(5, text)])], "host string, root int, blocks array<struct<branch: bigint, text: string>>")
    got = S.word_counts(pages).collect()
    assert len(got) == 200 and {r.n for r in got} == {2}


def test_words_are_shuffled_in_rows_of_a_branch(spark):
    """The counts are those of the definition, whatever tasks hold, and a shuffled row has many of them."""
    import random
    from collections import Counter

    random.seed(5)
    rows = []
    for k in range(4_000):
        blocks = [(random.randint(0, 3), " ".join(random.choices(["a", "b7", "b12", "", "\u0663x", *(f"w{c}" for c in "abcdefghijklmnopq")], k=random.randint(1, 30)))) for _ in range(random.randint(0, 4))]
        rows.append((random.choice([*["h"] * 10, "g", ""]), int(random.random() < 0.1), blocks))
    want = Counter()
    for host, root, blocks in rows:
        want.update({(host, root, b, S.signed(S.xxhash.xxh64_intdigest(S.re.sub(r"\d+", "0", w)))) for b, text in blocks for w in text.split(" ")})
    pages = spark.createDataFrame(rows, "host string, root int, blocks array<struct<branch: bigint, text: string>>").repartition(2)
    counts = S.word_counts(pages)
    got = [((r.host, r.root, r.branch, r.word), r.n) for r in counts.collect()]
    assert len(got) == len(want) and dict(got) == want and max(want.values()) > 2 * 256
    under = counts._jdf.queryExecution().executedPlan().toString().split("hashpartitioning(host")[-1]
    assert "words#" in under and "word#" not in under


def exchange(counts):
    """The metrics of the shuffle of words in a plan that has run."""
    at = counts._jdf.queryExecution().executedPlan()
    while (name := at.getClass().getSimpleName()) != "ShuffleExchangeExec":
        at = at.executedPlan() if name == "AdaptiveSparkPlanExec" else at.plan() if name.endswith("QueryStageExec") else at.children().head()
    return {k: at.metrics().apply(k).value() for k in ("shuffleRecordsWritten", "dataSize")}


def test_a_task_tells_the_words_of_a_host_once_and_packed(spark, monkeypatch):
    """Pages of several hosts lie mixed in a task that holds fewer counts than it meets; a host that alone is too large is told in pieces."""
    from collections import Counter

    words = [f"w{chr(97 + a)}{chr(97 + b)}{chr(97 + c)}" for a in range(20) for b in range(20) for c in range(10)]

    def site(page):
        return [(page % 8, 0, [(7, " ".join(words[(page // 8) % 4 :: 4])), (8, "short one")])]

    def checked(rows):
        pages = spark.createDataFrame(rows, "host int, root int, blocks array<struct<branch: bigint, text: string>>").selectExpr("cast(host as string) AS host", "root", "blocks").coalesce(1)
        counts = S.word_counts(pages)
        got = {(r.host, r.branch, r.word): r.n for r in counts.collect()}
        want = Counter()
        for host, _, blocks in rows:
            want.update({(str(host), b, S.signed(S.xxhash.xxh64_intdigest(w))) for b, text in blocks for w in text.split(" ")})
        assert got == want
        return exchange(counts), {(h, b, w >> S.PART_SHIFT) for h, b, w in got}, len(got)

    monkeypatch.setattr(S, "HELD_COUNTS", 12_000)
    rows = [r for page in range(2_400) for r in site(page)]
    shuffled, keys, n = checked(rows)
    assert shuffled["shuffleRecordsWritten"] == len(keys) and shuffled["dataSize"] < 8.5 * n
    monkeypatch.setattr(S, "HELD_COUNTS", 3_000)
    shuffled, keys, n = checked(rows)
    assert shuffled["shuffleRecordsWritten"] > len(keys)


def test_packed_words_are_read_back():
    import numpy as np

    rng = np.random.default_rng(3)
    top = (1 << S.PART_SHIFT) - 1
    for n in (1, 2, 63, 64, 65, 1_000, 40_000):
        for most in (n + 1, 1 << 40, top):
            words = np.unique(rng.integers(0, most, n, np.int64, endpoint=True))
            assert (S.unpacked(S.packed(words), len(words)) == words).all()
    for words in ([0], [top], [0, top], range(100), range(top - 99, top + 1)):
        words = np.array(words, np.int64)
        code = S.packed(words)
        assert (S.unpacked(code, len(words)) == words).all() and len(code) <= 8 * len(words) + 1
