"""Toxicity classifier, regularised by counterfactuals.

A text's features are its words and the first 3 to 6 letters of them, each with the logarithm of its
count, and the logarithm of the text's length in words.  A logistic model learns weights of the features
that tell most about the labels.  It must not learn that a group's name is toxic because toxic texts
mention it: in sentences of labelled texts that hold identity terms, each term is swapped for the next
of its group, and in a second copy for the group's neutral word; the mean squared change of the score (as
log-odds) is added to the loss, times ``FAIR``.  The first makes the terms of a group weigh alike, the
second as much as a word that names no group.

The sample is bounded: at most ``SAMPLE`` texts of each class and ``SAMPLE_BYTES`` of them, in the order
of a hash of the id, whole texts only; texts of over ``TEXT_BYTES`` are not learnt from, only scored; at
most ``SENTENCES`` sentences of a text are swapped.  Scoring is row by row, without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, free_names, small_batches

SAMPLE, SAMPLE_BYTES, TEXT_BYTES, SENTENCES = 3000, 32 << 20, 1 << 20, 4
FEATURES, LEAST_TEXTS, RIDGE, STEPS, FAIR = 1500, 3, 0.3, 600, 10.0
#: Folds by crc32 of the id as text; this one is held out from learning.
FOLDS, HELD_OUT = 4, 2
FLAG = 0.3
STARTS = (3, 4, 5, 6)
LENGTH = "#"  # not a word
WORD, SENTENCE = r"[^\W\d_]+", r"[^.!?\n]+"
#: Words a worker keeps the features of.
CACHE = 1 << 18
#: Identity terms by group, the group's neutral word last.
IDENTITY = tuple(
    tuple(g.split())
    for g in (
        "muslim christian jewish hindu buddhist atheist catholic protestant sikh religious",
        "muslims christians jews hindus buddhists atheists catholics protestants sikhs believers",
        "women men people",
        "woman man person",
        "female male human",
        "girl boy child",
        "girls boys children",
        "gay lesbian bisexual transgender straight heterosexual homosexual queer adult",
        "black white asian latino african european hispanic arab tall",
        "american mexican chinese indian russian german french british turkish polish nigerian japanese local",
        "americans mexicans indians russians germans turks poles nigerians locals",
        "immigrant refugee migrant foreigner native citizen",
        "immigrants refugees migrants foreigners natives citizens",
        "old young elderly teenage busy",
        "blind deaf disabled autistic busy",
    )
)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


@dataclass(frozen=True)
class Model:
    intercept: float
    weights: dict[str, float] = field(default_factory=dict)


def word_features(word: str) -> list[str]:
    return [f"={word}", *(word[:k] for k in STARTS if len(word) >= k)]


def words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def features(found: list[str]) -> dict[str, float]:
    counts: Counter[str] = Counter()
    for w, n in Counter(found).items():
        for f in word_features(w):
            counts[f] += n
    return {f: math.log1p(n) for f, n in counts.items()} | {LENGTH: math.log1p(len(found))}


def swapped(sentence: list[str], identity: tuple[tuple[str, ...], ...] = IDENTITY) -> list[list[str]]:
    """The words with each identity term swapped for the next of its group, and for the group's neutral word; [] if there is none."""
    after = {t: (g[(k + 1) % (len(g) - 1)], g[-1]) for g in identity for k, t in enumerate(g[:-1])}
    return [[after[w][k] if w in after else w for w in sentence] for k in (0, 1)] if any(w in after for w in sentence) else []


def logistic(x: np.ndarray, y: np.ndarray, changes: np.ndarray, fair: float, ridge: float, steps: int) -> tuple[float, np.ndarray]:
    """Intercept and weights least in mean log loss + ridge / rows * |w|^2 / 2 + fair * mean squared change, by accelerated descent."""
    n, d = x.shape
    a = np.column_stack((x, np.ones(n, x.dtype)))
    pull = np.append(np.full(d, ridge / n), 0.0)
    w = probe = np.zeros(d + 1)
    v = np.ones(d + 1) / math.sqrt(d + 1)

    def curve(u: np.ndarray) -> np.ndarray:
        bent = a.T @ (a @ u) / (4 * n) + pull * u
        if len(changes):
            bent[:d] += 2 * fair * (changes.T @ (changes @ u[:d])) / len(changes)
        return bent

    top = 1.0
    for _ in range(30):  # the largest curvature, by powers
        v = curve(v)
        top = float(np.linalg.norm(v))
        v /= max(top, 1e-30)
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ probe, -30, 30)))
        slope = a.T @ (p - y) / n + pull * probe
        if len(changes):
            slope[:d] += 2 * fair * (changes.T @ (changes @ probe[:d])) / len(changes)
        new = probe - slope / (1.1 * top)
        probe = new + k / (k + 3) * (new - w)
        w = new
    return float(w[-1]), w[:-1]


def vector(found: list[str], place: dict[str, int]) -> dict[int, float]:
    return {place[f]: v for f, v in features(found).items() if f in place}


def changes_of(text: str, place: dict[str, int], identity: tuple[tuple[str, ...], ...]) -> list[dict[int, float]]:
    """How the features change by each swap of the text's first SENTENCES sentences with identity terms."""
    out: list[dict[int, float]] = []
    for s in re.findall(SENTENCE, text):
        own = words(s)
        for other in swapped(own, identity):
            x, y = vector(own, place), vector(other, place)
            out.append({k: d for k in x.keys() | y.keys() if (d := x.get(k, 0.0) - y.get(k, 0.0))})
        if len(out) >= 2 * SENTENCES:
            break
    return out


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame, list[int]]:
    """The bounded sample (order, text, label), and how many labelled ids of each class there are to learn from."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.min(label_col).alias("__label"))
    order = F.struct(F.xxhash64(id_col).alias("h"), F.col(id_col).alias("i"))
    totals = dict.fromkeys((0, 1), 0) | {r[0]: r[1] for r in known.groupBy("__label").count().collect()}
    one = [known.where(F.col("__label") == k).orderBy(order).limit(SAMPLE) for k in (0, 1)]
    few = one[0].unionByName(one[1])  # 2 * SAMPLE ids at most
    rows = docs.select(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text")).join(F.broadcast(few), id_col)
    # Long texts go before they are summed: one must not use up the sample.
    rows = rows.where(F.octet_length("__text") <= TEXT_BYTES).groupBy(id_col, "__label").agg(F.min("__text").alias("__text"))
    before = Window.partitionBy("__label").orderBy(order, "__text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__upto", F.sum(F.octet_length("__text")).over(before)).where(F.col("__upto") <= SAMPLE_BYTES)
    return cut(rows.select(order.alias("order"), F.col("__text").alias("text"), F.col("__label").cast("int").alias("label")).repartition(16)), [totals[0], totals[1]]


def telling(rows: DataFrame, most: int = FEATURES) -> list[str]:
    """The features whose presence departs most from chance, by z-score, among those of LEAST_TEXTS texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter[str] = Counter()
            ones: Counter[str] = Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = {f for w in set(words(text)) for f in word_features(w)}
                total.update(found)
                if label:
                    ones.update(found)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64()), pa.array([ones[f] for f in total], pa.int64())], ["f", "n", "ones"])

    counts = rows.select("text", "label").mapInArrow(run, "f string, n long, ones long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"))
    share = rows.agg(F.avg("label")).first()[0]
    z = F.abs(F.col("ones") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share) + 0.5)
    return [r["f"] for r in counts.where(F.col("n") >= LEAST_TEXTS).select("f", F.round(z, 9).alias("z")).orderBy(F.desc("z"), "f").limit(most).collect()]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", identity: tuple[tuple[str, ...], ...] = IDENTITY, fair: float = FAIR) -> Model:
    """Learn from labels outside the held-out fold; without both classes every text gets the base rate.

    Of several labels of one id the smaller counts; other labels than 0 and 1, and null ids, are left
    out.  Of several rows of one id the smallest text counts, once.  A null text is empty; one of over
    TEXT_BYTES is not learnt from.  Empty tables give the base rate of one in two.  The texts stay on the
    executors: the driver gets the chosen features and each text's values of them.
    """
    small_batches(docs.sparkSession)
    rows, totals = sample(docs, labels, id_col, text_col, label_col)
    prior = math.log((totals[1] + 1) / (totals[0] + 1))
    if rows.select("label").distinct().count() < 2:
        return Model(prior)
    names = [*telling(rows), LENGTH]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {f: k for k, f in enumerate(names)}
        for batch in batches:
            out = []
            for text in batch.column(2).to_pylist():
                out.append([vector(words(text), place), *changes_of(text, place, identity)])
            lists = [[list(map(part, x)) for x in out] for part in (dict.keys, dict.values)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([[list(x) for x in one] for one in some], pa.list_(pa.list_(kind))) for some, kind in zip(lists, (pa.int32(), pa.float64())))], ["order", "label", "at", "value"])

    kind = f"order {rows.schema['order'].dataType.simpleString()}, label int, at array<array<int>>, value array<array<double>>"
    got = sorted(rows.select("order", "label", "text").mapInArrow(run, kind).collect(), key=lambda r: tuple(r["order"]))

    def matrix(some: list[tuple[list[int], list[float]]]) -> np.ndarray:
        out = np.zeros((len(some), len(names)), np.float32)
        for i, (at, value) in enumerate(some):
            out[i, at] = value
        return out

    y = np.array([r["label"] for r in got], np.float32)
    changes = matrix([x for r in got for x in zip(r["at"][1:], r["value"][1:])])
    intercept, weights = logistic(matrix([(r["at"][0], r["value"][0]) for r in got]), y, changes, fair, RIDGE, STEPS)
    # The sample's classes are balanced by its bound; the corpus's are not.
    ones = float(y.sum())
    return Model(intercept + prior - math.log(ones / (len(y) - ones)), {f: float(x) for f, x in zip(names, weights)})


class Scorer:
    """Scores texts by a model; keeps the features of words it has met."""

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}
        self.names = sorted(model.weights)
        self.place = {f: k for k, f in enumerate(self.names)}
        self.weights = [model.weights[f] for f in self.names]

    def of_word(self, word: str) -> list[int]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            found = self.known[word] = [k for f in word_features(word) if (k := self.place.get(f)) is not None]
        return found

    def score(self, text: str) -> float:
        found = words(text)
        counts: dict[int, int] = {}
        for w, n in Counter(found).items():
            for k in self.of_word(w):
                counts[k] = counts.get(k, 0) + n
        x = self.model.intercept + self.model.weights.get(LENGTH, 0.0) * math.log1p(len(found))
        x += math.fsum(self.weights[k] * math.log1p(n) for k, n in counts.items())
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, x))))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with ``__score`` (0 to 1, higher: toxic is likelier) at the end.

    Null texts are empty and score as a text without words; texts of any length are scored whole; equal
    texts, so repeated rows too, score the same; other columns pass through, whatever their names (if
    one is ``__score``, the added column gets underscores); an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    out = T.StructType([*docs.schema, T.StructField(*free_names(docs, "__score"), T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = Scorer(model)
        for batch in batches:
            scores = [by.score(t.as_py() or "") for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], out.names)

    return docs.mapInArrow(run, out)
