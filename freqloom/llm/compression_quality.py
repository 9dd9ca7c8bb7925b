"""Quality classifier by compression: zstandard dictionaries of good and of bad text.

Two dictionaries are trained on labelled texts.  A text is compressed with each in blocks of ``BLOCK``
bytes (so the dictionary, not the text's own past, explains every block of a long text too); the
difference of the two compressed sizes over the text's size is the one feature of a logistic
calibration.  ``PRIOR_BYTES`` of average text are added to each text, so that one too short to tell
gets about the base rate.  Dictionaries and calibration use different halves of the sample.

The sample is bounded: at most ``SAMPLE`` texts of each class and ``SAMPLE_BYTES`` of them, taken in
the order of a hash of the id, whole texts only; texts of over ``TEXT_BYTES`` are not learnt from, only
scored.  Scoring is row by row, without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_names, small_batches

SAMPLE, SAMPLE_BYTES, TEXT_BYTES = 2000, 32 << 20, 1 << 20
DICT_BYTES, BLOCK, LEVEL, PRIOR_BYTES = 65536, 512, 3, 48
#: Folds by crc32 of the id as text; this one is held out from learning.
FOLDS, HELD_OUT = 5, 0
KEEP = 0.3


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


@dataclass(frozen=True)
class Model:
    good: bytes | None
    bad: bytes | None
    intercept: float
    slope: float
    center: float = 0.0


def dictionary(texts: list[bytes], size: int = DICT_BYTES) -> bytes | None:
    """A trained dictionary; with too little text to train on, the text itself; without any, None."""
    parts = [x[i : i + BLOCK] for x in texts for i in range(0, len(x), BLOCK)]
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except (zstandard.ZstdError, ValueError):
        whole = b"".join(texts)[-size:]
        return whole if len(whole) >= 8 else None


def compressors(model: Model) -> list[zstandard.ZstdCompressor]:
    return [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(x), write_content_size=False, write_checksum=False, write_dict_id=False) for x in (model.good, model.bad)]


def difference(text: bytes, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> int:
    """Compressed size by the bad dictionary less that by the good one."""
    sizes = [sum(len(c.compress(text[i : i + BLOCK])) for i in range(0, len(text), BLOCK)) for c in (good, bad)]
    return sizes[1] - sizes[0]


def feature(difference: np.ndarray, size: np.ndarray, center: float) -> np.ndarray:
    return (difference + PRIOR_BYTES * center) / (size + PRIOR_BYTES)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Intercept and slope by Newton steps."""
    a, w = np.column_stack((np.ones(len(x)), x)), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge * np.eye(2), a.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[list[tuple[bytes, int]], list[int]]:
    """The bounded sample, in hash order, and how many labelled ids of each class there are to learn from."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.min(label_col).alias("__label"))
    order = F.struct(F.xxhash64(id_col).alias("h"), F.col(id_col).alias("i"))
    totals = dict.fromkeys((0, 1), 0) | {r[0]: r[1] for r in known.groupBy("__label").count().collect()}
    one = [known.where(F.col("__label") == k).orderBy(order).limit(SAMPLE) for k in (0, 1)]
    few = one[0].unionByName(one[1])  # 2 * SAMPLE ids at most
    rows = docs.select(id_col, F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("__text")).join(F.broadcast(few), id_col)
    # Long texts go before they are summed: one must not use up the sample.
    rows = rows.where(F.length("__text") <= TEXT_BYTES).groupBy(id_col, "__label").agg(F.min("__text").alias("__text"))
    before = Window.partitionBy("__label").orderBy(order, "__text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__upto", F.sum(F.length("__text")).over(before)).where(F.col("__upto") <= SAMPLE_BYTES)
    got = rows.orderBy(order, "__text").select("__text", "__label").collect()
    return [(bytes(r[0]), r[1]) for r in got], [totals[0], totals[1]]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn from labels outside the held-out fold; without both classes every text gets the base rate.

    Of several labels of one id the smaller counts; other labels than 0 and 1, and null ids, are left
    out.  Of several rows of one id the smallest text counts, once.  A null text is empty; one of over
    TEXT_BYTES is not learnt from.  Empty tables give the base rate of one in two.
    """
    small_batches(docs.sparkSession)
    rows, totals = sample(docs, labels, id_col, text_col, label_col)
    prior = math.log((totals[1] + 1) / (totals[0] + 1))
    texts = {k: [t for t, y in rows if y == k] for k in (0, 1)}
    good, bad = dictionary(texts[1][::2]), dictionary(texts[0][::2])
    rest = [(t, k) for k in (0, 1) for t in texts[k][1::2]]
    ones = sum(k for _, k in rest)
    if good is None or bad is None or not 0 < ones < len(rest):
        return Model(None, None, prior, 0.0)
    by = compressors(Model(good, bad, 0, 0))
    d, n, y = (np.array(x, float) for x in zip(*((difference(t, *by), len(t), k) for t, k in rest)))
    share = (totals[1] + 1) / (sum(totals) + 2)
    center = sum(w * d[y == k].sum() / max(1, n[y == k].sum()) for k, w in ((1, share), (0, 1 - share)))
    intercept, slope = logistic(feature(d, n, center), y)
    # The sample's classes are balanced by its bound; the corpus's are not.
    return Model(good, bad, intercept + prior - math.log(ones / (len(rest) - ones)), slope, center)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with ``__score`` (0 to 1, higher: good text is likelier) at the end.

    Null texts are empty and score about the base rate; texts of any length are scored whole; equal
    texts, so repeated rows too, score the same; other columns pass through, whatever their names (if
    one is ``__score``, the added column gets underscores); an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    out = T.StructType([*docs.schema, T.StructField(*free_names(docs, "__score"), T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = compressors(model) if model.good is not None else None
        for batch in batches:
            texts = [(t.as_py() or "").encode("utf-8", "replace") for t in batch.column(at)]
            d = np.array([difference(t, *by) if by else 0 for t in texts], float)
            x = feature(d, np.array([len(t) for t in texts], float), model.center)
            p = 1 / (1 + np.exp(-np.clip(model.intercept + model.slope * x, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], out.names)

    return docs.mapInArrow(run, out)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = KEEP) -> DataFrame:
    """The rows of docs that score at least ``least``; ties all stay.  See score for odd rows."""
    scored = score(docs, fit(docs, labels, id_col, text_col), text_col)
    return scored.where(F.col(scored.columns[-1]) >= least).select(*docs.columns)
