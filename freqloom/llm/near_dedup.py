"""Near-duplicate removal with SimHash trees: the pipeline's variant, for texts that share 0.8 of their five-word shingles.

At that similarity two 64-bit SimHashes differ by about ten bits, too many for shards of equal bits.  So
shards are MinHash buckets here: a text stands in ``BANDS`` of them, each keyed by ``ROWS`` minima of
its shingle set; sets that share 0.8 meet in one with probability 1 - (1 - 0.8^4)^20 = 0.99997.  In a
shard a BK-tree over the texts' SimHashes finds who lies within ``RADIUS`` bits (mean 9.7, standard
deviation 2.9 at 0.8, so one pair in 10^5 is further apart); what it finds is a candidate, and the
shingle sets, which come with the shard, decide at once.  Only links that join two components leave it.

First each text meets the ones on its way down the tree, which joins most copies.  Then the texts outside
the shard's largest component search the tree.  They skip whoever shares none of their rarest shingles:
of two sets that share 0.8, the first fifth of each in a common order has a shingle of the other.  So a
large group of copies is neither compared nor emitted pair by pair.

Texts with equal shingle sets are one node throughout, and of shards with the same nodes one is searched.  A shard of over ``TREE`` nodes is cut into
sub-shards, each with the same ``PIVOTS`` nodes of the whole shard, through which its copies join those
of the others; then the texts outside the shard's largest component visit its other sub-shards.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_names, small_batches
from .components import components
from .simhash import BKTree, majority

#: Linked from NUM / DEN of the shingles of both on.
NUM, DEN = 4, 5
SHINGLE, SEED, BANDS, ROWS, RADIUS, TREE, PIVOTS = 5, 42, 20, 4, 22, 1024, 64
CHUNK = 1 << 12
#: Fixed odd factors: the permutations of the 64-bit hashes.
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes, words: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a text of fewer words is one shingle, one without words has none."""
    found = text.lower().split()  # of bytes: A-Z only, and blanks are \\x20 and \\x09-\\x0d
    if not found:
        return np.empty(0, np.uint64)
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[min(words, len(found)) - 1 :]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts.tolist(), last.tolist())), np.uint64, len(last)))


def node_of(hashes: np.ndarray) -> int:
    """64 bits of the set's SHA-256, signed."""
    return int.from_bytes(hashlib.sha256(hashes.tobytes()).digest()[:8], "big", signed=True)


def band_keys(hashes: np.ndarray) -> list[int]:
    """The shards of a set, none for an empty one."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), CHUNK):
        least = np.minimum(least, (hashes[None, at : at + CHUNK] * FACTORS[:, None]).min(axis=1))
    return [xxhash.xxh64_intdigest(x.tobytes(), k) - (1 << 63) for k, x in enumerate(least.reshape(BANDS, ROWS))]


Batches = Iterator[pa.RecordBatch]


def signatures(rows: DataFrame) -> DataFrame:
    """(id, digest, node, n, fp, keys) from (id, digest, text): n is the size of the shingle set, fp its SimHash."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            sets = [shingle_set(text.as_py()) for text in batch.column(2)]
            columns = [pa.array([node_of(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array([majority(x) for x in sets], pa.int64()), pa.array([band_keys(x) for x in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["id", "digest", "node", "n", "fp", "keys"])

    return rows.mapInArrow(run, "id long, digest long, node long, n long, fp long, keys array<long>")


def shingle_sets(rows: DataFrame) -> DataFrame:
    """(node, hashes) from (id, digest, text), a row for each node."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for text in batch.column(2):
                hashes = shingle_set(text.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([node_of(hashes)], pa.int64()), pa.array([hashes.view(np.int64)], pa.list_(pa.int64()))], ["node", "hashes"])

    return rows.mapInArrow(run, "node long, hashes array<long>").dropDuplicates(["node"])


class Member(NamedTuple):
    """A node in a tile: holds: it is searched for, else it asks; top: its component so far."""

    fp: int
    node: int
    top: int
    holds: bool
    hashes: np.ndarray


class Forest:
    """Components of nodes."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.up.setdefault(x, x)) != x:
            self.up[x] = x = self.up[up]
        return x

    def join(self, a: int, b: int) -> None:
        self.up[self.root(a)] = self.root(b)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets share NUM / DEN of their union."""
    few, many = min(len(a), len(b)), max(len(a), len(b))
    return few * DEN >= many * NUM and len(np.intersect1d(a, b, assume_unique=True)) * (NUM + DEN) >= (few + many) * NUM


def rarest(members: list[Member]) -> list[list[int]]:
    """For each member the numbers of its rarest shingles, so many that a similar set must share one of them as its own."""
    _, inverse, counts = np.unique(np.concatenate([m.hashes for m in members]), return_inverse=True, return_counts=True)
    order = np.empty(len(counts), np.int64)
    order[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    out, at = [], 0
    for m in members:
        own, at = order[inverse[at : at + len(m.hashes)]], at + len(m.hashes)
        most = len(own) - -(-len(own) * NUM // DEN) + 1
        own = np.sort(own)[:most]
        out.append(own[own >= (counts == 1).sum()].tolist())  # whoever has a shingle alone shares it with nobody
    return out


def local_links(members: list[Member], radius: int) -> Iterator[tuple[int, int]]:
    """(a, b): similar nodes of a tile whose link joins two components, until none is left to join.

    If nobody asks, the holders outside the largest component do.
    """
    forest, tree, at = Forest(), BKTree(), {}
    for m in members:
        forest.join(m.node, m.top)

    def link(x: Member, y: Member) -> bool:
        if forest.root(x.node) == forest.root(y.node) or not similar(x.hashes, y.hashes):
            return False
        forest.join(x.node, y.node)
        return True

    asking = [k for k, m in enumerate(members) if not m.holds]
    for k, x in enumerate(members):
        if x.holds:
            for fp, d in tree.way(x.fp) if not asking else ():
                if d <= radius and link(x, members[at[fp][0]]):
                    yield x.node, members[at[fp][0]].node
            tree.add(x.fp)
            at.setdefault(x.fp, []).append(k)
    if not asking:
        tops = Counter(forest.root(m.node) for m in members)
        if len(tops) < 2:
            return
        largest = tops.most_common(1)[0][0]
        asking = [k for k, m in enumerate(members) if forest.root(m.node) != largest]
    rare, postings = rarest(members), defaultdict(list)
    for k, m in enumerate(members):
        if m.holds:
            for shingle in rare[k]:
                postings[shingle].append(k)
    for k in asking:
        x = members[k]
        share = {j for shingle in rare[k] for j in postings[shingle] if forest.root(members[j].node) != forest.root(x.node)}
        if share:
            for fp in tree.near(x.fp, radius):
                for j in at[fp]:
                    if j in share and link(x, members[j]):
                        yield x.node, members[j].node


def searched(tiles: DataFrame, radius: int) -> DataFrame:
    """Distinct (a, b) found in the tiles: rows (fp, node, top, holds, hashes, shard, i)."""

    def run(batches: Batches) -> Batches:
        key, members = None, []
        out: list[tuple[int, int]] = []

        def flush() -> pa.RecordBatch:
            a, b = ([x[k] for x in out] for k in (0, 1))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64).tolist()
            ends = np.cumsum(pc.list_value_length(batch.column(4)).to_numpy())[:-1]
            sets = np.split(batch.column(4).flatten().to_numpy(), ends)
            for fp, node, top, holds, hashes, *at in zip(fps, *(batch.column(k).to_pylist() for k in (1, 2, 3)), sets, *(batch.column(k).to_pylist() for k in (5, 6))):
                if at != key:
                    out.extend(local_links(members, radius) if len(members) > 1 else ())
                    key, members = at, []
                members.append(Member(fp, node, top, holds, hashes.copy()))
            if len(out) > 10_000:
                yield flush()
        out.extend(local_links(members, radius) if len(members) > 1 else ())
        yield flush()

    dealt = tiles.select("fp", "node", "top", "holds", "hashes", "shard", "i").repartition("shard", "i").sortWithinPartitions("shard", "i")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def links(texts: DataFrame, distinct: DataFrame, tree: int = TREE, pivots: int = PIVOTS, radius: int = RADIUS) -> DataFrame:
    """(a, b): links that connect the nodes of ``distinct`` (node, n, fp, keys, id, digest) wherever a candidate pair is similar."""
    placed = distinct.select("fp", "node", "id", "digest", F.explode("keys").alias("shard"))
    sums = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"sum{k}") for k in (1, 2)]
    sized = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("held"), *sums).where("held > 1")
    # Most near copies meet in many shards: of shards with the same nodes, one will do.
    sized = sized.groupBy("held", "sum1", "sum2").agg(F.min("shard").alias("shard")).select("shard", "held")
    parts = F.ceil(F.col("held") / tree).cast("int")
    placed = placed.join(sized, "shard").withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int"))
    placed = cut(placed)
    # Only texts that share a shard with another are compared at all.
    sets = cut(shingle_sets(texts.join(placed.select("id", "digest").distinct(), ["id", "digest"], "left_semi")))
    pivot = (F.col("parts") > 1) & (F.pmod(F.xxhash64("node", F.lit(9)), F.greatest(F.lit(1), F.floor(F.col("held") / pivots))) == 0)
    where = F.when(pivot, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("own"))
    first = placed.select("fp", "node", F.col("node").alias("top"), F.lit(True).alias("holds"), "shard", F.explode(where).alias("i"))
    found = cut(searched(first.join(sets, "node"), radius))
    large = placed.where("parts > 1")
    if large.isEmpty():
        return found
    roots = components(found).select(F.col("a").alias("node"), F.col("b").alias("root"))
    member = large.join(roots, "node", "left").withColumn("top", F.coalesce("root", "node"))
    largest = member.groupBy("shard", "top").agg(F.count(F.lit(1)).alias("n")).groupBy("shard").agg(F.max(F.struct("n", "top"))["top"].alias("largest"))
    member = cut(member.join(largest, "shard"))
    asks = member.where("top <> largest").select("fp", "node", "top", F.lit(False).alias("holds"), "shard", F.explode(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: i != F.col("own"))).alias("i"))
    asked = asks.select("shard", "i").distinct()
    holds = member.select("fp", "node", "top", F.lit(True).alias("holds"), "shard", F.col("own").alias("i")).join(asked, ["shard", "i"], "left_semi")
    return found.union(searched(holds.select(*asks.columns).union(asks).join(sets, "node"), radius))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tree: int = TREE, pivots: int = PIVOTS) -> DataFrame:
    """The rows of docs that stay: of each component of linked texts, the one with the smallest id.

    Words are split at blanks, with A-Z lower-cased; a null text has none, and texts without words are
    alike.  A null id is smaller than any other.  Of rows with one id each text counts by itself; of
    rows with equal ids and texts one stays.  Other columns pass through unchanged, whatever their
    names; an empty table gives no rows.
    """
    the_id, digest, nth = free_names(docs, "__id", "__digest", "__nth")
    own = [F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias(the_id), F.xxhash64(F.col(text_col).cast("binary")).alias(digest)]
    docs_too = docs.select("*", *own)
    small_batches(docs.sparkSession)
    texts = docs_too.select(the_id, digest, F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))).toDF("id", "digest", "text")
    row = F.min(F.struct("id", "digest")).alias("least")
    distinct = signatures(texts).groupBy("node").agg(row, F.min("n").alias("n"), F.min("fp").alias("fp"), F.min("keys").alias("keys"))
    distinct = cut(distinct.select("node", "least.*", "n", "fp", "keys"))
    roots = components(links(texts, distinct, tree, pivots)).select(F.col("a").alias("node"), F.col("b").alias("root"))
    kept = distinct.join(roots, "node", "left").groupBy(F.coalesce("root", "node")).agg(row).select(F.col("least.id").alias(the_id), F.col("least.digest").alias(digest))
    # The window needs no shuffle of its own: it is dealt as the join is.
    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map" not in f.dataType.simpleString()]
    first = Window.partitionBy(the_id, digest).orderBy(F.xxhash64(*plain))
    out = docs_too.join(kept, [the_id, digest], "left_semi")
    return out.withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1).select(*docs.columns)
