"""Conversation structure repair: cheapest edits by a DAG of tight arcs searched from both ends.

A conversation's rows and the role grammar ``(s?(ua)+)?`` span a graph: node (row, state), arcs Keep,
Rerole, Delete and Insert with their costs.  Least costs from the start (forward) and to the end
(backward) tell all optimal arcs: an arc is tight if forward + cost + backward is the least cost of all.
A walk over tight arcs only then holds the set of states that the edits so far may have led to (the
frontier) and takes the least letter that leaves it, which gives the least of all cheapest edit strings.

No conversation needs to fit a task.  Equal rows are counted before they are shuffled; rows are dealt by
range of (conversation, turn, digest) into partitions that cut long conversations.  The costs through a
partition's share are a 4 x 4 matrix, of which two conversations of each partition can need one (the
first and the last); from these the driver gets the costs at each cut, and in the same way the
frontier there.  Only the digest of a cut conversation's repaired text passes one task, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import cut, small_batches

KEEP, REROLE, DELETE, INSERT = "KRDI"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
NOT_BLANK, NO_END = r"[^\x20\x09-\x0D]", r"[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z"
#: States: nothing yet, after the system turn, after a user, after an assistant; and those a conversation may end in.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES, ENDS = range(4), (START, ASSISTANT)
AFTER = {("s", START): SYSTEM, **{("u", q): USER for q in (START, SYSTEM, ASSISTANT)}, ("a", USER): ASSISTANT}
NAMES = {"u": "user", "a": "assistant"}
INSERTS = [(q, r, role) for (role, q), r in AFTER.items() if role != "s"]
LEGAL = ("su", "ua", "au")
FAR = 1 << 60
#: Bytes of repaired text in one row on the way to its digest.
PIECE = 1 << 20
#: Rows of a batch that goes back to Spark.
ROWS = 500


class Arc(NamedTuple):
    state: int
    to: int
    cost: int
    edit: str
    role: str | None


def arcs_of(code: str) -> list[Arc]:
    """The arcs over a row, by its code: role initial (``-``: any other) and fault (space: none, t: truncated, x: must go)."""
    found = [Arc(q, q, DELETE_COST, DELETE, None) for q in STATES]
    if code[1] == "x":
        return found
    more = TRUNCATED_COST * (code[1] == "t")
    for (role, q), r in AFTER.items():
        if role == code[0]:
            found.append(Arc(q, r, more, KEEP, None))
        if role in NAMES:
            found.append(Arc(q, r, REROLE_COST + more, REROLE, NAMES[role]))
    return found


CODES = [a + b for a in "sua-" for b in " tx"]
ARCS = {code: arcs_of(code) for code in CODES}


def inserted(costs: list[int], back: bool = False) -> list[int]:
    """Least costs when turns may be inserted after (back: before) them; two rounds reach every state."""
    costs = list(costs)
    for _ in range(2):
        for q, r, _role in INSERTS:
            a, b = (r, q) if back else (q, r)
            costs[b] = min(costs[b], costs[a] + INSERT_COST)
    return costs


def over(costs: list[int], code: str, back: bool = False) -> list[int]:
    out = [FAR] * len(STATES)
    for a in ARCS[code]:
        x, y = (a.to, a.state) if back else (a.state, a.to)
        out[y] = min(out[y], costs[x] + a.cost)
    return out


def forward(codes: list[str], first: list[int]) -> list[list[int]]:
    """Least cost of each node from the start, layer by layer (a layer lies before each row and after the last)."""
    layers = [inserted(first)]
    for code in codes:
        layers.append(inserted(over(layers[-1], code)))
    return layers


def backward(codes: list[str], last: list[int]) -> list[list[int]]:
    layers = [inserted(last, True)]
    for code in reversed(codes):
        layers.append(inserted(over(layers[-1], code, True), True))
    return layers[::-1]


AT_START, AT_END = [0, FAR, FAR, FAR], [0 if q in ENDS else FAR for q in STATES]


def matrix(codes: list[str]) -> list[list[int]]:
    """Least cost from each state before the rows to each state after them."""
    return [forward(codes, [0 if p == q else FAR for p in STATES])[-1] for q in STATES]


def walk(codes: list[str], before: list[int], after: list[int], frontier: set[int], to_end: bool) -> tuple[list[tuple[int, str, str | None]], set[int]]:
    """The least cheapest edits as (row, letter, new role or None) from a frontier, and the frontier they end in.

    before, after: least costs from the conversation's start to the states before the rows, and from
    the states after the rows to its end; to_end: no rows follow.  From one state a letter leads to one
    state, with one role, so the letters tell the whole repair.
    """
    ahead, behind = forward(codes, before), backward(codes, after)
    best = min(a + b for a, b in zip(ahead[0], behind[0]))
    edits: list[tuple[int, str, str | None]] = []
    k = 0
    while k < len(codes) or to_end and not any(q in ENDS and ahead[k][q] == best for q in frontier):
        tight = [(INSERT, r, NAMES[role]) for q, r, role in INSERTS if q in frontier and ahead[k][q] + INSERT_COST + behind[k][r] == best]
        if k < len(codes):
            tight += [(a.edit, a.to, a.role) for a in ARCS[codes[k]] if a.state in frontier and ahead[k][a.state] + a.cost + behind[k + 1][a.to] == best]
        if not tight:  # the frontier lies on no cheapest way
            return edits, set()
        letter = min(t[0] for t in tight)
        frontier = {t[1] for t in tight if t[0] == letter}
        edits.append((k, letter, next(t[2] for t in tight if t[0] == letter)))
        k += letter != INSERT
    return edits, frontier


class Part(NamedTuple):
    """What is known of a partition's share of a conversation that other partitions share: costs and states at its ends."""

    before: list[int]
    after: list[int]
    frontier: frozenset[int]
    initial: str | None
    last: bool


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies) of the rows that stay, damaged by crc32 of ``conv:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 takes its full stops, exclamation and question marks out, 3
    repeats it (copies is 2), 4 makes its role user.  A null is one space, but for conv and turn, which
    stay null where they stand for themselves.
    """

    def known(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(known(conv_col), F.lit(":"), known(turn_col)).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(known(text_col), "[.!?]", "")).otherwise(known(text_col))
    out = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.when(kind == 4, F.lit("user")).otherwise(known(role_col)).alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).cast("long").alias("copies"), kind.alias("kind"))
    return out.where("kind <> 0").drop("kind")


def faults(rows: DataFrame) -> DataFrame:
    """(conv, turn, digest, role, text, copies, blank, seen, truncated), one row for equal ones, dealt by range and sorted.

    rows: (conv, turn, role, text, copies).  Turns ascend, null first; rows of one turn are in the order of
    the digests of role and text.  seen: the conversation has the same role and text before (the second
    and later copies of a row are always seen before).
    """
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit(" ")) for x in ("role", "text"))
    known = rows.select("conv", "turn", role.alias("role"), text.alias("text"), "copies")
    digest = F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    unique = known.withColumn("digest", digest).groupBy("conv", "turn", "digest").agg(F.sum("copies").alias("copies"), F.min("role").alias("role"), F.min("text").alias("text"))
    unique = cut(unique)
    first = unique.groupBy(F.col("conv").alias("c"), F.col("digest").alias("d")).agg(F.min("turn").alias("from"), F.max(F.col("turn").isNull()).alias("null_first"))
    seen = F.when(F.col("null_first"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("from"))
    marked = unique.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")))
    marked = marked.select("conv", "turn", "digest", "role", "text", "copies", (~F.col("text").rlike(NOT_BLANK)).alias("blank"), seen.alias("seen"), F.col("text").rlike(NO_END).alias("truncated"))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("digest").asc()]
    return cut(marked.repartitionByRange(*order).sortWithinPartitions(*order))


def code_of(initial: str, blank: bool, seen: bool, truncated: bool) -> str:
    return (initial if initial and initial in "sua" else "-") + ("x" if blank or seen else "t" if truncated else " ")


def columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def shares(dealt: DataFrame) -> dict[tuple[Any, int], Part]:
    """What each partition must know of the conversations that it shares with others: at most two for a partition."""
    rows = dealt.select("conv", F.substring("role", 1, 1).alias("initial"), "blank", "seen", "truncated", F.spark_partition_id().alias("part"))
    rough = T.StructType([dealt.schema["conv"], *T.StructType.fromDDL("part int, costs array<long>, initial string, ends array<int>").fields])

    def run(known: dict | None):
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def told(conv: Any, codes: list[str], initial: str) -> tuple:
                if known is None:
                    return conv, part, [min(c, FAR) for line in matrix(codes) for c in line], initial, []
                p = known[(conv, part)]
                return conv, part, [], initial, [next(iter(walk(codes, p.before, p.after, {q}, p.last)[1]), -1) for q in STATES]

            part, held, codes, initial, out, first = -1, None, [], "", [], True
            for batch in batches:
                for conv, start, blank, seen, truncated, part in zip(*(c.to_pylist() for c in batch.columns)):
                    if codes and conv != held:
                        if first and (known is None or (held, part) in known):
                            out.append(told(held, codes, initial))
                        first, codes = False, []
                    held, initial = conv, start
                    codes.append(code_of(start, blank, seen, truncated))
            if codes and (known is None or (held, part) in known):
                out.append(told(held, codes, initial))
            if out:
                yield columns(out, to_arrow_schema(rough))

        return of

    cuts: dict[Any, list] = {}
    for r in sorted(rows.mapInArrow(run(None), rough).collect(), key=lambda r: r["part"]):
        cuts.setdefault(r["conv"], []).append(r)
    cuts = {k: v for k, v in cuts.items() if len(v) > 1}
    if not cuts:
        return {}
    found: dict[tuple[Any, int], Part] = {}
    for conv, parts in cuts.items():
        lines = [[r["costs"][4 * q : 4 * q + 4] for q in STATES] for r in parts]
        before, after = [AT_START], [AT_END]
        for m in lines[:-1]:
            before.append([min(FAR, *(before[-1][p] + m[p][q] for p in STATES)) for q in STATES])
        for m in reversed(lines[1:]):
            after.append([min(FAR, *(after[-1][q] + m[p][q] for q in STATES)) for p in STATES])
        for k, r in enumerate(parts):
            found[(conv, r["part"])] = Part(before[k], after[-1 - k], frozenset(), parts[k - 1]["initial"] if k else None, k == len(parts) - 1)
    ends = {(r["conv"], r["part"]): r["ends"] for r in rows.mapInArrow(run(found), rough).collect()}
    for conv, parts in cuts.items():
        frontier = frozenset({START})
        for r in parts:
            found[(conv, r["part"])] = found[(conv, r["part"])]._replace(frontier=frontier)
            frontier = frozenset(ends[(conv, r["part"])][q] for q in frontier)
    return found


def repair(rows: DataFrame) -> DataFrame:
    """The edits of each conversation in order: (conv, part, at, cut, edit, role, text, cost, fault, illegal).

    rows: (conv, turn, role, text, copies), see damage and faults.  part, at: the partition and the place
    in it; cut: the conversation goes on in another partition.  edit: K, R, D or I; role and text: the
    repaired turn (null: deleted).  fault: blank, duplicate or truncated, the first that holds, of the row
    that the edit is of (null: none, or inserted); illegal: that row's role initial may not follow the one
    before.  A null role or text is one space; of null conversation ids all rows are one conversation;
    repeated rows are duplicates; texts of any length are taken whole; an empty table has no edits.
    """
    small_batches(rows.sparkSession)
    dealt = faults(rows)
    known = shares(dealt)
    out = T.StructType([dealt.schema["conv"], *T.StructType.fromDDL("part int, at long, cut boolean, edit string, role string, text string, cost long, fault string, illegal boolean").fields])
    whole = Part(AT_START, AT_END, frozenset({START}), None, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, at = to_arrow_schema(out), 0

        def edited(conv: Any, part: int, held: list[tuple]) -> Iterator[tuple]:
            nonlocal at
            p = known.get((conv, part), whole)
            codes = [code_of(role[:1], *x) for role, _, _, *x in held]
            edits, _ = walk(codes, p.before, p.after, set(p.frontier), p.last)
            before = p.initial
            for k, letter, new in edits:
                if letter == INSERT:
                    yield conv, part, at, (conv, part) in known, INSERT, new, "", INSERT_COST, None, False
                    at += 1
                    continue
                role, text, copies, blank, seen, truncated = held[k]
                for again in range(copies):
                    initial = role[:1]
                    illegal, before = before is not None and before + initial not in LEGAL, initial
                    fault = "blank" if blank else "duplicate" if seen or again else "truncated" if truncated else None
                    edit = DELETE if again else letter
                    cost = DELETE_COST if edit == DELETE else REROLE_COST * (edit == REROLE) + TRUNCATED_COST * (fault == "truncated")
                    yield conv, part, at, (conv, part) in known, edit, None if edit == DELETE else new or role, None if edit == DELETE else text, cost, fault, illegal
                    at += 1

        def batched(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            some: list[tuple] = []
            for x in found:
                some.append(x)
                if len(some) == ROWS:
                    yield columns(some, schema)
                    some = []
            if some:
                yield columns(some, schema)

        def all_edits() -> Iterator[tuple]:
            last, part, held = None, -1, []
            for batch in batches:
                for conv, part, *row in zip(*(c.to_pylist() for c in batch.columns)):
                    if held and conv != last:
                        yield from edited(last, part, held)
                        held = []
                    last = conv
                    held.append(row)
            if held:
                yield from edited(last, part, held)

        yield from batched(all_edits())

    return dealt.select("conv", F.spark_partition_id().alias("part"), "role", "text", "copies", "blank", "seen", "truncated").mapInArrow(run, out)


def summary(edits: DataFrame) -> DataFrame:
    """(conv, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of repair()'s edits, in their partitions and order.

    audit: the letters of the edits; repaired_sha256: of the repaired ``role:text``, joined by line feeds.
    A conversation in one partition is done there; the pieces of one that was cut meet in its order.
    """
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    out = T.StructType([edits.schema["conv"], *T.StructType.fromDDL(f"part int, at long, cut boolean, {', '.join(f'{c} long' for c in counts)}, audit string, piece binary, repaired_sha256 string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(out)

        def found() -> Iterator[tuple]:
            first, sums, audit, text, any_text, sha = None, [0] * 5, [], bytearray(), False, None

            def told() -> tuple:
                conv, part, at, is_cut = first
                return conv, part, at, is_cut, *sums, "".join(audit), bytes(text) if is_cut else None, None if is_cut else sha.hexdigest()

            for batch in batches:
                for conv, part, at, is_cut, edit, role, line, cost, fault, illegal in zip(*(c.to_pylist() for c in batch.columns)):
                    if first and conv != first[0]:
                        yield told()
                        first = None
                    elif first and is_cut and (len(text) >= PIECE or len(audit) >= PIECE):
                        yield told()
                        first = None
                    if not first:
                        first, sums, audit, text, any_text, sha = (conv, part, at, is_cut), [0] * 5, [], bytearray(), False, hashlib.sha256()
                    for k, c in enumerate(counts[:3]):
                        sums[k] += fault == c
                    sums[3] += illegal
                    sums[4] += cost
                    audit.append(edit)
                    if edit != DELETE:
                        new = f"{role}:{line}".encode("utf-8", "replace")
                        if is_cut:  # pieces end each line, as more may follow
                            text += new + b"\n"
                        else:
                            sha.update((b"\n" if any_text else b"") + new)
                        any_text = True
            if first:
                yield told()

        for row in found():
            yield columns([row], schema)

    done = cut(edits.mapInArrow(run, out))
    whole = done.where("not cut").select("conv", *counts, "audit", "repaired_sha256")
    parts = done.where("cut")
    # Of cut conversations, at most two for each partition, the text passes one task in pieces.
    streams = parts.select("conv", "part", "at", "piece").repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "part", "at")
    kind = T.StructType([edits.schema["conv"], T.StructField("repaired_sha256", T.StringType())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(kind)
        held, sha, rest = None, None, b""
        for batch in batches:
            for conv, piece in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                if sha is not None and conv != held:
                    yield columns([(held, sha.hexdigest())], schema)
                    sha = None
                if sha is None:
                    held, sha, rest = conv, hashlib.sha256(), b""
                if piece:  # the last line feed waits for a line after it
                    sha.update(rest + piece[:-1])
                    rest = b"\n"
        if sha is not None:
            yield columns([(held, sha.hexdigest())], schema)

    digests = streams.mapInArrow(digest, kind).withColumnRenamed("conv", "c")
    pieces = F.array_sort(F.collect_list(F.struct("part", "at", "audit")))
    sums = parts.groupBy("conv").agg(*[F.sum(c).alias(c) for c in counts], F.array_join(F.transform(pieces, lambda x: x["audit"]), "").alias("audit"))
    return whole.unionByName(sums.join(digests, F.col("conv").eqNullSafe(F.col("c"))).select("conv", *counts, "audit", "repaired_sha256"))


def audited(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation, damaged and repaired.

    Other columns are ignored, whatever their names.  A conversation of which no row is left has zeros, an
    empty audit and the digest of an empty text.  gaps: turn numbers missing between the least and the
    largest that are left.
    """
    conv, turn = F.col(conv_col), F.col(turn_col)
    source = conversations.select(conv.alias("conv"), turn.alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    rows = damage(source, "conv", "turn", "role", "text")
    gaps = rows.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps")).select(F.col("conv").alias("g"), "gaps")
    done = summary(repair(rows)).withColumnRenamed("conv", "c")
    every = source.select("conv").distinct()
    wide = every.join(done, F.col("conv").eqNullSafe(F.col("c")), "left").join(gaps, F.col("conv").eqNullSafe(F.col("g")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return wide.select(F.col("conv").alias(conv_col), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
