import functools
import hashlib
import random
import re
import sys
import zlib

import pytest
from pyspark.sql import functions as F

from freqloom.llm import conversations as C
from freqloom.llm import queries

from .helpers import EXTRA

sys.setrecursionlimit(20_000)
WS = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()


def cheapest(items):
    """(cost, edit letters, repaired turns) by trying everything; items: (role, text, fault)."""
    automaton = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    @functools.cache
    def best(k, q, inserts):
        """Least (cost, letters, turns) of the rest; a few inserts in a row are enough."""
        found = [(0, "", ())] if k == len(items) and q in ("", "a") else []

        def go(cost, letter, turn, k2, q2, inserts2):
            c, s, t = best(k2, q2, inserts2)
            found.append((cost + c, letter + s, turn + t))

        if inserts < 3:
            for x, name in (("u", "user"), ("a", "assistant")):
                if (q, x) in automaton:
                    go(2, "I", ((name, ""),), k, automaton[q, x], inserts + 1)
        if k < len(items):
            role, text, fault = items[k]
            go(3, "D", (), k + 1, q, 0)
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if (q, role[:1]) in automaton:
                    go(more, "K", ((role, text),), k + 1, automaton[q, role[:1]], 0)
                for x, name in (("u", "user"), ("a", "assistant")):
                    if (q, x) in automaton:
                        go(2 + more, "R", ((name, text),), k + 1, automaton[q, x], 0)
        return min(found, default=(10**9, "", ()))

    return best(0, "", 0)


def brute(rows):
    rows = [tuple(r)[:4] for r in rows]
    out = {}
    for conv in {r[0] for r in rows}:
        left = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            role = "user" if kind == 4 else role
            left += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        left.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        seen, items = set(), []
        for _, role, text in left:
            bare = text.strip(WS)
            items.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None))
            seen.add((role, text))
        turns = [t for t, _, _ in left if t is not None]
        cost, audit, repaired = cheapest(items)
        count = [sum(f == x for _, _, f in items) for x in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(items, items[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest())
    return out


def result(df):
    got = df.collect()
    assert len({r[0] for r in got}) == len(got)
    return {r[0]: tuple(r)[1:] for r in got}


def invented(seed, conversations, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(conversations):
        for _ in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "no", "Why?", " ", "", None, f"Text {rng.randint(0, 5)}! \n", "é.\x85", "open\x0b"])
            rows.append((None if c == 0 else c, rng.choice([None, *range(12)]), role, text))
    return rows


def test_random_conversations_equal_trying_everything(spark):
    rows = invented(3, 150, 9)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in EXTRA})
    assert result(C.audited(df)) == brute(rows)


@pytest.fixture
def many_partitions(spark):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


def test_long_conversations_are_cut_and_hold_together(spark, many_partitions):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", f"{t}?", f"{t}", ""])) for c, n in ((1, 200), (2, 1), (3, 120)) for t in range(n)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert C.repair(C.damage(df)).where("cut").select("part").distinct().count() > 2
    assert result(C.audited(df)) == brute(rows)


def test_long_texts_copies_nulls_and_empty_tables(spark):
    long = "word " * 200_000
    rows = [(7, 0, "user", long), (7, 1, "assistant", long + "."), (8, None, None, None), (9, 5, "user", "Same.")]
    rows += [(9, 5, "user", "Same.")] * 150 + [(9, 6, "assistant", "Yes.")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert result(C.audited(df)) == brute(rows)
    assert C.audited(spark.createDataFrame([], SCHEMA)).count() == 0


def test_conversation_without_rows_left(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert result(C.audited(spark.createDataFrame([(conv, 0, "user", "Hi.")], SCHEMA))) == {conv: (0, 0, 0, 0, 0, 0, "", EMPTY)}


@pytest.mark.parametrize("pieces", [1, 3])
def test_shares_of_a_conversation_give_its_walk(pieces):
    rng = random.Random(pieces)
    for _ in range(200):
        codes = [rng.choice(C.CODES) for _ in range(rng.randint(0, 12))]
        whole, end = C.walk(codes, C.AT_START, C.AT_END, {C.START}, True)
        at = sorted(rng.randint(0, len(codes)) for _ in range(pieces))
        parts = [codes[a:b] for a, b in zip([0, *at], [*at, len(codes)])]
        before, letters, frontier = C.AT_START, "", {C.START}
        for k, part in enumerate(parts):
            after = C.AT_END
            for later in reversed(parts[k + 1 :]):
                after = C.backward(later, after)[0]
            edits, frontier = C.walk(part, before, after, frontier, k == len(parts) - 1)
            letters += "".join(e[1] for e in edits)
            before = C.forward(part, before)[-1]
        assert letters == "".join(e[1] for e in whole) and frontier == end


def test_query_equals_trying_everything(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert result(queries.queries()["op12_conversation_repair"](spark, sf_dir)) == brute(rows)
