"""SimHash near-duplicates: BK-trees over fingerprint shards, then connected components.

Fingerprints within ``RADIUS`` = 3 bits agree in at least three of six blocks of ten or eleven bits, so
a shard is a choice of three blocks with their values, about 32 bits, and each distinct fingerprint
stands in twenty shards; no link is lost, and what unlike fingerprints share a shard stays rare however
many there are.  Shards of more than ``TREE`` fingerprints are cut into sub-shards, and every pair of
sub-shards is a tile of its own: one tree of bounded size, sent to the tile's queries.  In a tile
children hang at their Hamming distance from the parent and a search follows only edges within the
radius.  Trees are sent to the tiles of their shard, not to every executor: together they grow with the
corpus.  Each tile returns only its local components, one row for each linked fingerprint, never its
pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_bytes
from .components import components

RADIUS, SHINGLE, SEED, TREE = 3, 3, 42, 4096
#: Fingerprints held by over 1 / HEAVY of the rows (HEAVY of them at most) are joined by broadcast.
HEAVY = 1024
CHUNK = 1 << 16
#: First bit and width of each block.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))


def majority(hashes: np.ndarray) -> int:
    """64 bits, signed: a bit is set if it is set in over half of the unsigned hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[at : at + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprint(text: bytes, words: int = SHINGLE) -> int:
    """64 bits, signed: a bit is set if it is set in over half of the hashes of the word shingles."""
    found = text.lower().split()  # of bytes: A-Z only, and blanks are \\x20 and \\x09-\\x0d
    if not found:
        return 0
    line, n = b" ".join(found), max(1, len(found) - words + 1)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[min(words, len(found)) - 1 :]
    return majority(np.fromiter((xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts.tolist(), last.tolist())), np.uint64, n))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) for each row; a null text is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(x.as_py()) for x in batch.column(1)], pa.int64())], [id_col, "fp"])

    src = text_bytes(docs, id_col, text_col)
    return src.mapInArrow(run, f"`{id_col}` {src.schema[id_col].dataType.simpleString()}, fp long")


class BKTree:
    """Distinct 64-bit values; a child hangs at its Hamming distance from its parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        if self.values:
            at = 0
            while True:
                d = (self.values[at] ^ value).bit_count()
                if not d:
                    return
                below = self.children[at].get(d)
                if below is None:
                    self.children[at][d] = len(self.values)
                    break
                at = below
        self.values.append(value)
        self.children.append({})

    def way(self, value: int) -> Iterator[tuple[int, int]]:
        """(value, distance) of the nodes on the way that a value would go down as it is added."""
        at = 0 if self.values else None
        while at is not None:
            d = (self.values[at] ^ value).bit_count()
            yield self.values[at], d
            at = self.children[at].get(d) if d else None

    def near(self, value: int, radius: int) -> list[int]:
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(self.values[at])
            if below := self.children[at]:
                if len(below) <= 2 * radius:
                    todo += [c for e, c in below.items() if -radius <= e - d <= radius]
                else:
                    todo += [below[e] for e in range(max(1, d - radius), d + radius + 1) if e in below]
        return found


def tile_links(tree: list[int], queries: list[int] | None, radius: int) -> Iterator[tuple[int, int]]:
    """(value, least value of its local component), the least left out; queries None: the tree's own values."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    grown = BKTree()
    if queries is not None:
        for x in tree:
            grown.add(x)
    for x in tree if queries is None else queries:
        for y in grown.near(x, radius):
            a, b = root(x), root(y)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if queries is None:
            grown.add(x)
    return ((x, top) for x in list(parent) if (top := root(x)) != x)


def to_signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shards(fp: Column) -> Column:
    """The shards of a fingerprint: for each choice of three blocks, its number and the blocks' values in one long."""
    out = []
    for k, chosen in enumerate(combinations(BLOCKS, 3)):
        value = F.lit(k).cast("long")
        for first, width in chosen:
            value = F.shiftleft(value, width).bitwiseOR(F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1).cast("long")))
        out.append(value)
    return F.array(*out)


def tiled(placed: DataFrame) -> DataFrame:
    """(fp, shard, i, j, holds) dealt and sorted by tile: sub-shard i of a shard meets j >= i once; i holds the tree, j asks.

    placed: fp, shard and parts (sub-shards of its shard).
    """
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int")
    tiles = placed.select("fp", "shard", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    tiles = tiles.select("fp", "shard", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("holds"))
    return tiles.repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j")


def links(distinct: DataFrame, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """(a, b): links that connect all fingerprints of ``distinct`` (column fp, no repeats) within the radius."""
    if not 0 <= radius <= 3:
        raise ValueError("choices of three of six blocks find every link up to three differing bits")
    placed = distinct.select("fp", F.explode(shards(F.col("fp"))).alias("shard"))
    sized = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    tiles = tiled(placed.join(sized, "shard").select("fp", "shard", F.ceil(F.col("n") / tree).cast("int").alias("parts")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree_side, asking = None, [], []
        out: list[tuple[int, int]] = []

        def close() -> None:
            if key is not None and len(tree_side) + len(asking) > 1:
                out.extend(tile_links(tree_side, None if key[1] == key[2] else asking, radius))

        def flush() -> pa.RecordBatch:
            a, b = ([to_signed(x[k]) for x in out] for k in (0, 1))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64).tolist()
            for fp, shard, i, j, holds in zip(fps, *(batch.column(k).to_pylist() for k in range(1, 5))):
                if key is None or shard != key[0] or i != key[1] or j != key[2]:
                    close()
                    key, tree_side, asking = (shard, i, j), [], []
                (tree_side if holds else asking).append(fp)
            if len(out) > 10_000:
                yield flush()
        close()
        yield flush()

    return tiles.mapInArrow(run, "a long, b long").distinct()


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """(id, fingerprint, component_id) for each row; component_id is the smallest id that links reach.

    Texts without words have fingerprint zero, which links like any other.  Rows may repeat; a null id
    counts only where its component has no other.  Texts of any length count whole; equal texts have
    equal fingerprints.  Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    rows = cut(fingerprints(docs, id_col, text_col))
    distinct = cut(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("least")))
    roots = components(links(distinct.select("fp"), radius, tree))
    # A root is linked too, so its own row joins its component.
    member = roots.select(F.col("a").alias("fp"), F.col("b").alias("root")).union(roots.select("b", "b").distinct())
    linked = distinct.join(member, "fp").select("fp", "root", "least")
    low = linked.groupBy("root").agg(F.min("least").alias("low"))
    linked = linked.join(low, "root").select("fp", "low")
    by_fp = cut(distinct.join(linked, "fp", "left").select("fp", "n", F.coalesce("low", "least").alias("component_id")))
    total = by_fp.agg(F.sum("n")).first()[0] or 0
    heavy = by_fp.where(F.col("n") * HEAVY > total).select("fp", "component_id")
    often = rows.join(F.broadcast(heavy), "fp")
    seldom = rows.join(F.broadcast(heavy.select("fp")), "fp", "left_anti").join(by_fp.select("fp", "component_id"), "fp")
    return often.unionByName(seldom).select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
