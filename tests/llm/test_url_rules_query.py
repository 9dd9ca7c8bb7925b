import random

from freqloom.llm import queries as Q
from freqloom.llm import url_rules as U

URLS = [
    ("https://x.net/de/9", "net/de/", "allow"),
    ("https://a.example.net/de/7", "net/de/", "allow"),
    ("https://example.net/de/81", "example.net/de/8", "block"),
    ("http://a.com/en/", "com/en/", "block"),
    ("http://example.com/en/70", "example.com/en/7", "allow"),
    ("http://b.org/es/1", "org/es/", "block"),
]


def test_the_query_has_the_verdicts_of_the_contract(spark, tmp_path):
    rows = [(k, u) for k, (u, _, _) in enumerate(URLS)]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.rule, r.verdict) for r in Q.op4_url_rules(spark, str(tmp_path)).collect()}
    assert got == {k: (rule, verdict) for k, (_, rule, verdict) in enumerate(URLS)}


def test_a_rule_of_tokens_that_many_others_outdo_is_found(spark):
    """a, b and c together mean block; each alone says little, and a URL holds twelve tokens that say more."""
    draw = random.Random(1)
    rows = []
    for k in range(200):
        block = k < 60
        some = [f"t{x}" for x in range(12) if draw.random() < (0.95 if block else 0.2)]
        rows.append((some + (["a", "b", "c"] if block else draw.sample(["a", "b", "c"], 2)), "block" if block else "allow"))
    mined = U.mine(spark.createDataFrame(rows, "tokens array<string>, label string"), 0.2, 0.9, 1.5)
    assert ("a", "b", "c") in {r.tokens for r in mined if r.label == "block"}
