"""Exact neighbours by inner product, without the blocks of vectors that cannot matter.

Vectors are dealt to the nearest of a bounded number of pivots and, by their distance from it, to blocks of a
cell.  For a query q, a pivot p and a block between the distances lo and hi from p, no vector c of the block has
a larger inner product than q.p + |q| hi, nor than (|q|^2 + |c|^2 - g^2) / 2, g being how far |q - p| lies
outside [lo, hi], nor a smaller one than q.p - |q| hi.  A block is read for a query only if these bounds leave
the answer open, so the results are those of all pairs.

Null vectors take no part; vectors must have one length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freqloom.functions.vectors import dot
from freqloom.sources.storage import cut

from .evaluate import PACKED, couples, nearer, packed, packed_matrix, vectors_of

#: Pivots are a sample of the vectors, on the driver and in the closure of tasks: PIVOTS * dimension numbers.
PIVOTS = 256
#: Rows of a block, and queries that meet it in one tile.
BLOCK = 2048
#: Similarities are rounded to nine digits; bounds leave room for that and for the order of sums.
EPS = 1e-6


class Cells(NamedTuple):
    """blocks: (cell, block, ids, vs); bounds: (cell, block, lo, hi, norm, n); pivots and each cell's radius."""

    blocks: DataFrame
    bounds: DataFrame
    pivots: np.ndarray
    radius: np.ndarray


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column).astype(np.float64)


def cells(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, block: int = BLOCK) -> Cells:
    """Deal vectors to cells and blocks; they are written once to the shared folder, in blocks."""
    held = vectors.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"))
    sample = held.orderBy(F.xxhash64("id"), "id").limit(pivots).select("v").collect()
    if not sample:
        sample = [([0.0],)]
    p = np.stack([np.asarray(r[0], np.float64) for r in sample])

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                v = matrix(batch["v"])
                far = np.sqrt(np.maximum((v * v).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * v @ p.T, 0))
                cell = far.argmin(1)
                yield batch.assign(cell=cell, far=far[np.arange(len(cell)), cell], norm=np.sqrt((v * v).sum(1)))

    dealt = held.mapInPandas(deal, "id long, v array<double>, cell long, far double, norm double")
    order = ["cell", "far", "id"]
    placed = dealt.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("block", F.floor(F.monotonically_increasing_id() / block))
    packed = placed.groupBy("cell", "block").agg(  # at most ``block`` rows
        F.collect_list("id").alias("ids"), F.collect_list("v").alias("vs"), F.min("far").alias("lo"), F.max("far").alias("hi"), F.max("norm").alias("norm"), F.count(F.lit(1)).alias("n")
    )
    packed = cut(packed)
    bounds = packed.select("cell", "block", "lo", "hi", "norm", "n")
    radius = np.full(len(p), -np.inf)
    for r in bounds.groupBy("cell").agg(F.max("hi").alias("hi")).collect():  # a row for each pivot
        radius[r.cell] = r.hi
    return Cells(packed.select("cell", "block", "ids", "vs"), bounds, p, radius)


def open_blocks(asked: DataFrame, held: Cells) -> DataFrame:
    """(q, cell, block, n, low, gap): blocks that may hold a vector with a similarity of at least ``least`` to q.

    asked: (q, v, least).  low: no vector of the block is less similar; gap: how far q's distance from the
    pivot lies outside those of the block.
    """
    p, radius = held.pivots, held.radius

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch) and np.isfinite(radius).any():
                v = matrix(batch["v"])
                norm2, met = (v * v).sum(1), v @ p.T
                far = np.sqrt(np.maximum(norm2[:, None] + (p * p).sum(1)[None, :] - 2 * met, 0))
                i, cell = np.nonzero(met + np.sqrt(norm2)[:, None] * radius[None, :] >= batch["least"].to_numpy()[:, None] - EPS)
                yield pd.DataFrame({"q": batch["q"].to_numpy()[i], "cell": cell, "met": met[i, cell], "far": far[i, cell], "qnorm": np.sqrt(norm2)[i], "least": batch["least"].to_numpy()[i]})

    near = asked.select("q", "v", "least").mapInPandas(reach, "q long, cell long, met double, far double, qnorm double, least double")
    gap = F.greatest(F.col("lo") - F.col("far"), F.col("far") - F.col("hi"), F.lit(0.0))
    most = F.least(F.col("met") + F.col("qnorm") * F.col("hi"), (F.pow("qnorm", F.lit(2)) + F.pow("norm", F.lit(2)) - gap * gap) / 2)
    low = F.col("met") - F.col("qnorm") * F.col("hi")
    return near.join(held.bounds, "cell").where(most >= F.col("least") - EPS).select("q", "cell", "block", "n", low.alias("low"), gap.alias("gap"))


def in_tiles(pairs: DataFrame, asked: DataFrame, held: Cells, run: Callable[..., pd.DataFrame], schema: str, block: int = BLOCK) -> DataFrame:
    """What ``run`` makes of each block and the queries that are to read it, up to about ``block`` of them at a time.

    pairs: (q, cell, block); asked: (q, ...); run: from a row with those columns and ids, vs as arrays.
    """
    n = pairs.groupBy("cell", "block").agg(F.ceil(F.count(F.lit(1)) / block).alias("chunks"))
    dealt = pairs.join(n, ["cell", "block"]).withColumn("chunk", F.pmod(F.xxhash64("q"), "chunks")).select("q", "cell", "block", "chunk")
    packed = dealt.join(asked, "q").groupBy("cell", "block", "chunk").agg(*[F.collect_list(c).alias(c) for c in asked.columns])

    def tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                yield run(r)

    return packed.join(held.blocks, ["cell", "block"]).select(*asked.columns, "ids", "vs").mapInPandas(tiles, schema)


def top_k(queries: DataFrame, held: Cells, k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(q, rank, cand, sim): the k most similar vectors of each query, the query's own id left out; ties by id.

    First each query reads one block, the one of its nearest cell at its own distance from the pivot; the k-th
    similarity there closes most other blocks.  Query ids must be unique.
    """
    asked = cut(queries.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("q"), F.col(vector).cast("array<double>").alias("v")))

    def best(r) -> pd.DataFrame:
        q, ids = np.asarray(r.q, np.int64), np.asarray(r.ids, np.int64)
        sim = np.round(matrix(r.v) @ matrix(r.vs).T, 9)
        sim[q[:, None] == ids[None, :]] = -np.inf
        order = np.lexsort((np.broadcast_to(ids, sim.shape), -sim), axis=1)[:, :k]
        out = pd.DataFrame({"q": np.repeat(q, order.shape[1]), "cand": ids[order].ravel(), "sim": np.take_along_axis(sim, order, 1).ravel()})
        return out[np.isfinite(out["sim"])]

    p, radius = held.pivots, held.radius

    def at_home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch) and np.isfinite(radius).any():
                v = matrix(batch["v"])
                far = (v * v).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * v @ p.T
                far = np.where(np.isfinite(radius)[None, :], np.sqrt(np.maximum(far, 0)), np.inf)
                yield pd.DataFrame({"q": batch["q"], "cell": far.argmin(1), "far": far.min(1)})

    home = asked.mapInPandas(at_home, "q long, cell long, far double").join(held.bounds.select("cell", "block", "lo", "hi"), "cell")
    gap = F.greatest(F.col("lo") - F.col("far"), F.col("far") - F.col("hi"), F.lit(0.0))
    first = home.groupBy("q", "cell").agg(F.min_by("block", F.struct(gap, "block")).alias("block"))
    schema = "q long, cand long, sim double"
    first = cut(first)
    found = cut(in_tiles(first, asked, held, best, schema))
    kth = found.groupBy("q").agg(F.when(F.count(F.lit(1)) >= k, F.min("sim")).alias("kth"))
    bounded = asked.join(kth, "q", "left").select("q", "v", F.coalesce("kth", F.lit(float("-inf"))).alias("least"))
    rest = open_blocks(bounded, held).select("q", "cell", "block").join(first, ["q", "cell", "block"], "left_anti")
    near = found.unionByName(in_tiles(cut(rest), asked, held, best, schema))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "cand"))
    return near.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("q", "rank", "cand", F.round("sim", 6).alias("sim"))


def true_ranks(queries: DataFrame, candidates: DataFrame, held: Cells) -> DataFrame:
    """(query_id, rank): 1 + the candidates nearer than the query's best own one.

    queries: (query_id, own_id, v); candidates: (cand_id, own_id, v), the vectors of ``held``; a candidate is a
    query's own if own_id is equal.  Nearer is a larger similarity, or an equal one with a smaller id.  The own
    similarity is known before, so a block is left out, counted whole by its bounds, or read.  Packs of blocks meet
    packs of queries, so what is shuffled does not depend on how many blocks stay open.
    """
    own = queries.alias("q").join(candidates.alias("c"), "own_id").select("query_id", F.struct(F.round(dot(F.col("q.v"), F.col("c.v")), 9).alias("s"), (-F.col("cand_id")).alias("c")).alias("m"))
    best = own.groupBy("query_id").agg(F.max("m").alias("m")).select("query_id", F.col("m.s").alias("least"), (-F.col("m.c")).alias("own_cand"))
    asked = packed(queries.join(best, "query_id"), {"query_id": "i8", "least": "f8", "own_cand": "i8"}, "v", "ask_block")
    pivots = held.pivots

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                q, least, own = np.frombuffer(r.query_id, "i8"), np.frombuffer(r.least, "f8"), np.frombuffer(r.own_cand, "i8")
                ids, vs = np.frombuffer(r.ids, "i8"), vectors_of(r.vs)
                v = vectors_of(r.v)
                norm2, met = (v * v).sum(1), v @ pivots.T
                far, size = np.sqrt(np.maximum(norm2[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * met, 0)), np.sqrt(norm2)
                found, at = np.zeros(len(q), np.int64), 0
                for cell, n, lo, hi, norm in np.frombuffer(r.bounds, "f8").reshape(-1, 5):
                    cell, n = int(cell), int(n)
                    gap = np.maximum(np.maximum(lo - far[:, cell], far[:, cell] - hi), 0)
                    most = np.minimum(met[:, cell] + size * hi, (norm2 + norm * norm - gap * gap) / 2)
                    whole = met[:, cell] - size * hi > least + EPS
                    found[whole] += n
                    read = np.flatnonzero((most >= least - EPS) & ~whole)
                    if len(read):
                        found[read] += nearer(v[read], vs[at : at + n], ids[at : at + n], least[read], own[read])
                    at += n
                yield pd.DataFrame({"query_id": q, "nearer": found})

    tiles = couples(asked, gathered(held)).select("query_id", "least", "own_cand", "v", "ids", "vs", "bounds")
    counted = tiles.mapInPandas(run, "query_id long, nearer long").groupBy("query_id").agg(F.sum("nearer").alias("nearer"))
    return queries.join(best, "query_id").select("query_id").join(counted, "query_id", "left").select("query_id", (F.coalesce("nearer", F.lit(0)) + 1).alias("rank"))


def gathered(held: Cells) -> DataFrame:
    """(hold_block, ids, vs, bounds): blocks, in packs of about PACKED rows, as bytes; bounds: (cell, n, lo, hi, norm) of each."""
    rows = held.blocks.join(held.bounds, ["cell", "block"])
    n = max(1, -(-int(held.bounds.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // PACKED))
    dealt = rows.withColumn("hold_block", F.pmod(F.xxhash64("cell", "block"), F.lit(n)))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cell", "block"])
        vs = np.concatenate([matrix(x) for x in pdf["vs"]])
        single = bool((vs.astype("f4") == vs).all())
        return pd.DataFrame(
            {
                "hold_block": [pdf["hold_block"].iloc[0]],
                "ids": [np.concatenate(list(pdf["ids"])).astype("i8").tobytes()],
                "vs": [packed_matrix(vs, single)],
                "bounds": [pdf[["cell", "n", "lo", "hi", "norm"]].to_numpy("f8").tobytes()],
            }
        )

    return cut(dealt.groupBy("hold_block").applyInPandas(pack, "hold_block long, ids binary, vs binary, bounds binary"))
