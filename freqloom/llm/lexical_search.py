"""Ranked lexical search: sort-based accumulation of integer impacts.

Documents are cut into terms once; of each, the terms of the queries with their counts are kept, and
its length.  A task then takes its documents in chunks and, for each chunk, concatenates the arrays
(item, document, impact) of all matched terms, sorts the packed key (item, document) by radix and sums
runs of equal keys (``reduceat``): a document's whole score is made where the document is, so no
posting is shuffled.  Of each item the task keeps a heap of its best documents; these few rows are
range-partitioned by item, where heaps select again.

Queries go in blocks of at most ``BLOCK_TERMS`` terms with repeats, so that their index and each chunk's
arrays are bounded; every block goes over all documents.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from .common import LOWER, UPPER, cut, small_batches

#: What a term is made of, and the ranking's constants.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 20
#: Terms, repeats included, of the items of one block; and (item, document, impact) entries of one chunk.
BLOCK_TERMS, CHUNK = 1 << 17, 1 << 21


def terms(text: str | None) -> list[str]:
    return re.findall(TERM, text.translate(str.maketrans(UPPER, LOWER))) if text else []


class Queries(NamedTuple):
    """A block of items as an index: term t stands in items[starts[t]:starts[t + 1]], so many times each."""

    ids: list[Any]
    vocabulary: list[str]
    starts: np.ndarray
    items: np.ndarray
    times: np.ndarray


def index(items: list[tuple[Any, Counter]]) -> Queries:
    vocabulary = sorted({t for _, c in items for t in c})
    place = {t: k for k, t in enumerate(vocabulary)}
    found = sorted((place[t], k, n) for k, (_, c) in enumerate(items) for t, n in c.items())
    t, k, n = (np.array([x[i] for x in found], np.int64) for i in range(3))
    return Queries([i for i, _ in items], vocabulary, np.searchsorted(t, np.arange(len(vocabulary) + 1)), k, n)


def blocks(queries: DataFrame, id_col: str, text_col: str, block_terms: int) -> Iterator[Queries]:
    """The items in blocks, read one by one; of several rows with one id the least text counts."""
    one = queries.groupBy(F.col(id_col).alias("id")).agg(F.min(F.col(text_col).cast("string")).alias("text"))
    held: list[tuple[Any, Counter]] = []
    size = 0
    for r in one.orderBy("id").toLocalIterator():
        counts = Counter(terms(r["text"]))
        if held and size + counts.total() > block_terms:
            yield index(held)
            held, size = [], 0
        if counts:
            held.append((r["id"], counts))
            size += counts.total()
    if held:
        yield index(held)


def matched(docs: DataFrame, vocabulary: list[str], id_col: str, text_col: str) -> DataFrame:
    """(doc, n, terms, counts) of each document with a term: its length and the query terms it holds, by place in the vocabulary."""
    small_batches(docs.sparkSession)
    kind = to_arrow_type(docs.schema[id_col].dataType)
    schema = T.StructType([T.StructField("doc", docs.schema[id_col].dataType), *T.StructType.fromDDL("n long, terms array<int>, counts array<int>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: k for k, t in enumerate(vocabulary)}
        find, lower = re.compile(TERM).findall, str.maketrans(UPPER, LOWER)
        for batch in batches:
            ids, sizes, ks, ns = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = find((text.as_py() or b"").decode("utf-8", "replace").translate(lower))
                if found:
                    counts = {k: n for t, n in Counter(found).items() if (k := place.get(t)) is not None}
                    ids.append(doc)
                    sizes.append(len(found))
                    ks.append(list(counts))
                    ns.append(list(counts.values()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(sizes, pa.int64()), pa.array(ks, pa.list_(pa.int32())), pa.array(ns, pa.list_(pa.int32()))], schema.names)

    return docs.select(id_col, F.col(text_col).cast("string").cast("binary")).mapInArrow(run, schema)


def radix_order(keys: np.ndarray, bits: int) -> np.ndarray:
    """The stable ascending order of non-negative keys of so many bits, 16 bits a pass."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    for shift in range(16, bits, 16):
        digit = ((keys >> shift) & 0xFFFF).astype(np.uint16)
        order = order[np.argsort(digit[order], kind="stable")]
    return order


def accumulate(doc: np.ndarray, term: np.ndarray, impact: np.ndarray, queries: Queries, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(items, documents, scores) of postings (document, term, impact): one sum for each item and document that share a term."""
    width = queries.starts[term + 1] - queries.starts[term]
    total = int(width.sum())
    if not total:
        return (np.zeros(0, np.int64),) * 3
    posting = np.repeat(np.arange(len(term)), width)
    entry = np.arange(total) - np.repeat(np.cumsum(width) - width, width) + queries.starts[term][posting]
    shift = max(1, (docs - 1).bit_length())
    keys = queries.items[entry] << shift | doc[posting]
    values = impact[posting] * queries.times[entry]
    order = radix_order(keys, shift + max(1, (len(queries.ids) - 1).bit_length()))
    keys = keys[order]
    runs = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[runs] >> shift, keys[runs] & ((1 << shift) - 1), np.add.reduceat(values[order], runs)


def rank_block(hits: DataFrame, queries: Queries, weights: np.ndarray, n_docs: int, n_terms: int, top: int, item_type: T.DataType) -> DataFrame:
    """(item, rank, doc, score): for each item of a block its best documents; hits as matched() has them."""
    kind = hits.schema["doc"].dataType
    part = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("doc", kind), T.StructField("score", T.LongType())])
    doc_key = lambda d: (d is not None, d) if d is not None else (False, 0)

    def better(score: int, doc: Any) -> tuple:
        return -score, doc_key(doc)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple]] = {}

        def add(ids: list, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray) -> None:
            impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
            items, docs, scores = accumulate(doc, term, impact, queries, len(ids))
            bounds = np.flatnonzero(np.concatenate(([True], items[1:] != items[:-1], [True]))) if len(items) else []
            for a, b in zip(bounds[:-1], bounds[1:]):
                own = np.flatnonzero(scores[a:b] > 0) + a
                if len(own) > top:  # all that reach the last score that counts, ties too
                    own = own[scores[own] >= np.partition(scores[own], -top)[-top]]
                kept = best.setdefault(int(items[a]), [])
                floor = kept[-1][0] if len(kept) == top else None
                new = [(*better(int(scores[k]), ids[docs[k]]), ids[docs[k]]) for k in own if floor is None or -int(scores[k]) <= floor]
                if new:
                    best[int(items[a])] = heapq.nsmallest(top, kept + new, key=lambda x: x[:2])

        most = max(1, int(queries.starts[-1]))
        for batch in batches:
            ids, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            ks, ns = batch.column(2), batch.column(3)
            held = ks.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            term, tf = ks.flatten().to_numpy().astype(np.int64), ns.flatten().to_numpy().astype(np.int64)
            m = 100 - 25 + (25 * n * n_docs) // max(1, n_terms)
            ends = np.cumsum(held)
            step = max(1, CHUNK // most)
            for a in range(0, len(ids), step):
                b = min(len(ids), a + step)
                lo, hi = int(ends[a] - held[a]), int(ends[b - 1])
                add(ids[a:b], np.repeat(np.arange(b - a), held[a:b]), term[lo:hi], tf[lo:hi], m[a:b])
        rows = [(item, doc, -score) for item, kept in best.items() for score, _, doc in kept]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(to_arrow_schema(part))], part.names)

    out = T.StructType([T.StructField("item", item_type), *T.StructType.fromDDL("rank int").fields, *part.fields[1:]])

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple]] = {}
        for batch in batches:
            for item, doc, score in zip(*(c.to_pylist() for c in batch.columns)):
                kept, x = best.setdefault(item, []), (*better(score, doc), doc)
                kept.append(x)
                if len(kept) > 16 * top:
                    best[item] = heapq.nsmallest(top, kept, key=lambda x: x[:2])
        rows = [(queries.ids[item], k + 1, x[2], -x[0]) for item, kept in best.items() for k, x in enumerate(heapq.nsmallest(top, kept, key=lambda x: x[:2]))]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(to_arrow_schema(out))], out.names)

    return hits.mapInArrow(partial, part).repartitionByRange("item").mapInArrow(final, out)


def search(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text", top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item, rank, doc, score): for each item its ``top`` best documents of all, equal scores by ascending id (null first).

    A null text has no terms; a document without terms counts nowhere, an item without any, or whose
    terms stand in no document, has no rows; every row of docs is a document of its own, repeated rows
    too; of several rows of queries with one id the least text counts; texts of any length are taken
    whole; other columns are ignored, whatever their names; empty tables give no rows.
    """
    found = None
    item_type = queries.schema[item_col].dataType
    for block in blocks(queries, item_col, query_col, block_terms):
        hits = cut(matched(docs, block.vocabulary, id_col, text_col))
        n_docs, n_terms = hits.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(block.vocabulary), np.int64)
        for r in hits.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
            df[r["t"]] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        ranked = rank_block(hits, block, weights, n_docs, n_terms, top, item_type)
        found = ranked if found is None else found.unionByName(ranked)
    if found is None:
        empty = T.StructType([T.StructField("item", item_type), T.StructField("rank", T.IntegerType()), T.StructField("doc", docs.schema[id_col].dataType), T.StructField("score", T.LongType())])
        found = docs.sparkSession.createDataFrame([], empty)
    return found.select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")
