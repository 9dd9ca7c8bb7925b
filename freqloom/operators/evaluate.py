"""Evaluation over embeddings: prototypes, zero-shot accuracy, retrieval recall, tag metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freqloom.functions.vectors import dot, sigmoid
from freqloom.sources.storage import cut

#: Rows of a block of vectors: a similarity tile has BLOCK * BLOCK cells.
BLOCK = 2048
#: Rows of a block of vectors that is packed into bytes, and asked ones of a tile that are multiplied at a time.
PACKED, STRIP = 16_384, 256
#: Similarities that differ by more than this differ when rounded to nine digits.
CLOSE = 1e-8


def prototypes(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """(label, pos, value): mean vector of each label, scaled to length one; sums combine map-side."""
    mean = vectors.select(label, F.posexplode(vector).alias("pos", "x")).groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    length = F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy(label)))
    return mean.select(label, "pos", (F.col("m") / length).alias("value"))


def prototype_arrays(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """(label, proto): one array per label."""
    rows = prototypes(vectors, label, vector).groupBy(label).agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("p"))
    return rows.select(label, F.transform("p", lambda x: x["value"]).alias("proto"))


def by_classes(vectors: DataFrame, classes: DataFrame, id_col: str, vector: str, said: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(id, truth, label, sim): for each vector what ``said`` makes of its similarities to a block of classes.

    said: from labels, ascending, and a matrix (vectors x labels) to two matrices (vectors x any): labels
    and similarities.  Blocks of vectors meet blocks of classes in tiles; nothing goes through the driver.
    """
    asked = vectors.select(F.struct(F.col(id_col).alias("id"), F.col("label").alias("truth"), F.col(vector).alias("v")).alias("a"))
    held = classes.select(F.struct("label", "proto").alias("h"))
    kinds = {f.name: f.dataType.simpleString() for f in asked.schema["a"].dataType}
    out = f"id {kinds['id']}, truth {kinds['truth']}, label {classes.schema['label'].dataType.simpleString()}, sim double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for own, found in zip(batch["a"], batch["h"]):
                found = sorted(found, key=lambda x: x["label"])
                matrix = np.stack([np.asarray(x["proto"], np.float64) for x in found])
                sims = np.stack([np.asarray(x["v"], np.float64) for x in own]) @ matrix.T
                labels, sims = said(np.asarray([x["label"] for x in found]), sims)
                many = labels.shape[1]
                yield pd.DataFrame({"id": np.repeat(np.asarray([x["id"] for x in own]), many), "truth": pd.Series([x["truth"] for x in own for _ in range(many)], dtype=object), "label": labels.ravel(), "sim": sims.ravel()})

    found = tiles(asked, held, ["a"], ["h"]).mapInPandas(run, out)
    return found.select(F.col("id").alias(id_col), "truth", "label", "sim")


def class_similarity(vectors: DataFrame, classes: DataFrame, id_col: str, vector: str = "embedding") -> DataFrame:
    """(id, true label, label, sim) of every vector to every class: matrix products of blocks of vectors and blocks of classes."""
    return by_classes(vectors, classes, id_col, vector, lambda labels, sims: (np.broadcast_to(labels, sims.shape), sims))


def best_class(vectors: DataFrame, classes: DataFrame, id_col: str, vector: str = "embedding") -> DataFrame:
    """(id, truth, label): the class nearest to each vector; ties go to the lowest label."""

    def best(labels: np.ndarray, sims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sims = np.round(sims, 9)
        at = sims.argmax(1)[:, None]  # the first of the largest, and labels ascend
        return labels[at], np.take_along_axis(sims, at, 1)

    found = by_classes(vectors, classes, id_col, vector, best)
    if classes.count() > BLOCK:
        found = found.groupBy(id_col, "truth").agg(F.max(F.struct("sim", (-F.col("label")).alias("less"))).alias("m")).select(id_col, "truth", (-F.col("m.less")).alias("label"))
    return found.select(id_col, "truth", "label")


def image_probs(vectors: DataFrame, scale: float = 6.0, id_col: str = "vec_id") -> DataFrame:
    """(sample_id, concept_id, prob): tag probabilities of images, from their similarity to the classes."""
    sims = class_similarity(vectors, prototype_arrays(vectors), id_col)
    return sims.select(F.col(id_col).cast("long").alias("sample_id"), F.col("label").cast("long").alias("concept_id"), F.round(sigmoid(F.col("sim") * scale), 6).alias("prob"))


def zero_shot(vectors: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """(label, acc): share of vectors whose best class is theirs, in percent, for each label and (null) for all; ties go to the lowest label."""
    hit = best_class(vectors, prototype_arrays(vectors), id_col).select(F.col("truth").alias("label"), (F.col("truth") == F.col("label")).cast("double").alias("hit"))
    return hit.rollup("label").agg(F.round(F.avg("hit") * 100, 6).alias("acc"))


def softmax_weights(sims: DataFrame, id_col: str, scale: float = 1.0) -> DataFrame:
    """(id, label, weight): softmax over the labels of each vector."""
    w = Window.partitionBy(id_col)
    e = F.exp(F.col("sim") * scale - F.max(F.col("sim") * scale).over(w))
    return sims.select(id_col, "label", e.alias("e")).select(id_col, "label", (F.col("e") / F.sum("e").over(w)).alias("weight"))


def packed_blocks(rows: DataFrame, columns: list[str], name: str) -> tuple[DataFrame, int]:
    """Rows packed into blocks of about BLOCK (columns as arrays, and the block's number), and how many blocks."""
    n = max(1, -(-rows.count() // BLOCK))
    dealt = rows.select(*columns, F.pmod(F.xxhash64(columns[0]), F.lit(n)).alias(name))
    return dealt.groupBy(name).agg(*[F.collect_list(c).alias(c) for c in columns]), n


def tiles(asked: DataFrame, held: DataFrame, ask: list[str], hold: list[str]) -> DataFrame:
    """Every block of the asked rows with every block of the held ones, a row for each: (ask, hold) as arrays.

    Blocks meet by equality of both numbers, so a tile is a key of its own.  A merge join, as Spark takes the size of a
    side before its rows are multiplied for that after, and would send it whole to the driver and to every executor.
    """
    (a, n), (h, m) = packed_blocks(asked, ask, "ask_block"), packed_blocks(held, hold, "hold_block")
    a = a.withColumn("hold_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))))
    h = h.withColumn("ask_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return a.hint("merge").join(h, ["ask_block", "hold_block"]).select(*ask, *hold)


def top_k(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(q, rank, cand, sim): the k nearest vectors of each query, the query itself left out; ties by id.

    Blocks of queries meet blocks of vectors in matrix products; each tile gives k rows per query, never
    its similarities.
    """
    asked = queries.select(F.col(id_col).cast("long").alias("q"), F.col(vector).alias("qv"))
    held = vectors.select(F.col(id_col).cast("long").alias("cand"), F.col(vector).alias("cv"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                q, cand = np.asarray(r.q, np.int64), np.asarray(r.cand, np.int64)
                sim = np.round(np.stack(r.qv).astype(np.float64) @ np.stack(r.cv).astype(np.float64).T, 9)
                sim[q[:, None] == cand[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(cand, sim.shape), -sim), axis=1)[:, :k]
                out = pd.DataFrame({"q": np.repeat(q, order.shape[1]), "cand": cand[order].ravel(), "sim": np.take_along_axis(sim, order, 1).ravel()})
                yield out[np.isfinite(out["sim"])]

    near = tiles(asked, held, ["q", "qv"], ["cand", "cv"]).mapInPandas(run, "q long, cand long, sim double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "cand"))
    return near.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("q", "rank", "cand", F.round("sim", 6).alias("sim"))


def true_ranks(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, rank): 1 + the candidates nearer than the query's best own one.

    queries: (query_id, own_id, v); candidates: (cand_id, own_id, v); a candidate is a query's own if
    own_id is equal.  Nearer is a larger similarity, or an equal one with a smaller id.  Packed blocks of
    queries meet those of candidates in matrix products; each tile returns one count per query.
    """
    own = queries.alias("q").join(candidates.alias("c"), "own_id").select("query_id", F.struct(F.round(dot(F.col("q.v"), F.col("c.v")), 9).alias("s"), (-F.col("cand_id")).alias("c")).alias("m"))
    best = own.groupBy("query_id").agg(F.max("m").alias("m")).select("query_id", F.col("m.s").alias("own_sim"), (-F.col("m.c")).alias("own_cand"))
    asked = packed(queries.join(best, "query_id"), {"query_id": "i8", "own_sim": "f8", "own_cand": "i8"}, "v", "ask_block")
    held = packed(candidates, {"cand_id": "i8"}, "v", "hold_block").withColumnRenamed("v", "cv")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                ids, cand = np.frombuffer(r.query_id, "i8"), np.frombuffer(r.cand_id, "i8")
                n = nearer(vectors_of(r.v), vectors_of(r.cv), cand, np.frombuffer(r.own_sim, "f8"), np.frombuffer(r.own_cand, "i8"))
                yield pd.DataFrame({"query_id": ids, "nearer": n})

    counted = couples(asked, held).select("query_id", "own_sim", "own_cand", "v", "cand_id", "cv").mapInPandas(run, "query_id long, nearer long")
    return counted.groupBy("query_id").agg((F.sum("nearer") + 1).alias("rank"))


def packed(rows: DataFrame, columns: dict[str, str], vector: str, name: str) -> DataFrame:
    """Rows in blocks of about PACKED, by number ``name``: columns (of these numpy types) and vectors v as bytes."""
    single = dict(rows.dtypes)[vector] == "array<float>"  # exact in half the bytes
    dealt = rows.where(F.col(vector).isNotNull()).select(*columns, F.col(vector).alias("v"))
    n = max(1, -(-dealt.count() // PACKED))
    dealt = dealt.withColumn(name, F.pmod(F.xxhash64(next(iter(columns))), F.lit(n)))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        made = {c: [pdf[c].to_numpy(kind).tobytes()] for c, kind in columns.items()}
        return pd.DataFrame({name: [pdf[name].iloc[0]], **made, "v": [packed_matrix(np.stack(pdf["v"]), single)]})

    return cut(dealt.groupBy(name).applyInPandas(pack, f"{name} long, {', '.join(f'{c} binary' for c in columns)}, v binary"))


def packed_matrix(v: np.ndarray, single: bool) -> bytes:
    """A matrix as bytes: of each number, its columns, then the numbers."""
    return np.array([4 if single else 8, v.shape[1]], "i8").tobytes() + v.astype("f4" if single else "f8").tobytes()


def vectors_of(data: bytes) -> np.ndarray:
    """The matrix of packed_matrix, in doubles."""
    size, width = np.frombuffer(data, "i8", 2)
    return np.frombuffer(data, f"f{size}", offset=16).reshape(-1, width).astype("f8")


def couples(asked: DataFrame, held: DataFrame) -> DataFrame:
    """Every block of ``asked`` beside every one of ``held``, a row for each, by equality of both numbers; see tiles."""
    n, m = (int(x.agg(F.coalesce(F.max(c), F.lit(-1))).first()[0]) + 1 for x, c in ((asked, "ask_block"), (held, "hold_block")))
    if not n or not m:
        return asked.join(held.withColumnRenamed("hold_block", "ask_block"), "ask_block").limit(0)
    a = asked.withColumn("hold_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))))
    h = held.withColumn("ask_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return a.hint("merge").join(h, ["ask_block", "hold_block"])


def nearer(v: np.ndarray, held: np.ndarray, ids: np.ndarray, sim: np.ndarray, own: np.ndarray) -> np.ndarray:
    """How many of the held vectors are more similar to each v than ``sim``, or as similar (to nine digits) with a smaller id than ``own``."""
    found = np.zeros(len(v), np.int64)
    for k in range(0, len(v), STRIP):
        at = slice(k, k + STRIP)
        sims, s = v[at] @ held.T, sim[at, None]
        above = sims > s + CLOSE
        found[at] = above.sum(1)
        i, j = np.nonzero((sims >= s - CLOSE) ^ above)  # only these can be equal when rounded
        x, s, c = np.round(sims[i, j], 9), sim[at][i], own[at][i]
        found[at] += np.bincount(i[(x > s) | ((x == s) & (ids[j] < c))], minlength=len(sims))
    return found


def recall(ranks: DataFrame, ks: tuple[int, ...] = (1, 5, 10), by: list[str] | None = None) -> DataFrame:
    """([by], k, recall): percent of queries whose own candidate is among the first k."""
    each = ranks.select(*(by or []), "rank", F.explode(F.lit(list(ks)).cast("array<bigint>")).alias("k"))
    return each.groupBy(*(by or []), "k").agg(F.round(F.avg((F.col("rank") <= F.col("k")).cast("double")) * 100, 6).alias("recall"))


def contrastive_loss(pairs: DataFrame) -> DataFrame:
    """(batch, loss) from the scaled similarities (batch, ip, tp, s) of images and texts; equal numbers belong together.

    The mean, over images and over texts, of the negative log softmax of their own partner in the batch.
    """
    own = F.sum(F.when(F.col("ip") == F.col("tp"), F.col("s")))
    top = F.max("s")
    parts = []
    for side in ("ip", "tp"):
        most = pairs.groupBy("batch", side).agg(top.alias("top"), own.alias("own")).where("own IS NOT NULL")
        spread = pairs.join(most, ["batch", side]).groupBy("batch", side).agg(F.sum(F.exp(F.col("s") - F.col("top"))).alias("e"), F.max(F.col("top") - F.col("own")).alias("d"))
        parts.append(spread.select("batch", (F.log("e") + F.col("d")).alias("l")))
    return parts[0].unionByName(parts[1]).groupBy("batch").agg(F.avg("l").alias("loss"))


def average_precision(scored: DataFrame, group: str, eps: float = 1e-8) -> DataFrame:
    """(group, ap) from (group, id, score, hit): precision at each hit in descending order of score (ties: larger id first).

    Rows are range-partitioned by group and score, so a group of any size spreads over tasks; ranks and
    running hits within a partition are shifted by the sums of the partitions before.
    """
    order = (F.desc("score"), F.desc("id"))
    dealt = scored.select(group, "id", "score", "hit").repartitionByRange(F.col(group), *order)
    placed = cut(dealt.withColumn("part", F.spark_partition_id()))
    w = Window.partitionBy("part", group).orderBy(*order)
    local = placed.select("part", group, "hit", F.row_number().over(w).alias("rank"), F.sum("hit").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"))
    sizes = placed.groupBy("part", group).agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("h"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    sizes = sizes.select("part", group, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("n", "h")])
    ranked = local.join(sizes, ["part", group]).select(group, "hit", (F.col("rank") + F.col("n")).alias("rank"), (F.col("cum") + F.col("h")).alias("cum"))
    return ranked.groupBy(group).agg((F.sum(F.col("hit") * F.col("cum") / F.col("rank")) / (F.sum("hit") + eps)).alias("ap"))


def precision_recall(predicted: DataFrame, group: str, eps: float = 1e-9) -> DataFrame:
    """(group, p, r) from (group, said, hit) with 0 or 1 in both."""
    def total(c: Column) -> Column:
        return F.sum(c.cast("double"))

    both = F.col("said") * F.col("hit")
    return predicted.groupBy(group).agg((total(both) / (total(F.col("said")) + eps)).alias("p"), (total(both) / (total(F.col("hit")) + eps)).alias("r"))
