"""Many patterns in one pass over each text: an Aho-Corasick automaton of all concepts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Concepts of one automaton; a larger table goes in several, one after the other.
PATTERNS = 200_000


def mentions(texts: DataFrame, concepts: DataFrame, id_col: str, text_col: str = "text", concept_col: str = "concept", most: int = PATTERNS) -> DataFrame:
    """(concept, id): texts that hold a concept as whole words, or as the start of a plural-like word, each once.

    Both sides are lower-cased and a concept's underscores are spaces; only a-z, 0-9 and spaces of a text
    count.  Each text is read once for all concepts of an automaton, however many they are; no text meets a
    concept that it doesn't hold.  Null texts and concepts are found nowhere; repeated concepts count once;
    repeated rows of texts each have their concepts.
    """
    names = concepts.select(F.col(concept_col).cast("string").alias("c")).where("c IS NOT NULL").distinct()
    parts = max(1, -(-names.count() // most))
    kind = texts.schema[id_col].dataType.simpleString()
    src = texts.select(F.col(id_col).alias("id"), F.lower(F.col(text_col).cast("string")).alias("text")).where("text IS NOT NULL")

    def finding(block: list[str]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            patterns: dict[str, list[int]] = {}
            for k, c in enumerate(block):
                word = " " + c.replace("_", " ").lower()
                for p in (word + " ", word + "s"):
                    patterns.setdefault(p, []).append(k)
            tree = ahocorasick.Automaton()
            for p, ks in patterns.items():
                tree.add_word(p, ks)
            tree.make_automaton()
            for batch in batches:
                ids, found = [], []
                for k, text in enumerate(batch.column(1).to_pylist()):
                    held = {c for _, ks in tree.iter(" " + re.sub("[^a-z0-9 ]", "", text) + " ") for c in ks}
                    ids += [k] * len(held)
                    found += sorted(held)
                yield pa.RecordBatch.from_arrays([pa.array([block[c] for c in found], pa.string()), batch.column(0).take(pa.array(ids, pa.int64()))], ["concept", "id"])

        return src.mapInArrow(run, f"concept string, id {kind}")

    done = None
    for k in range(parts):
        block = [r["c"] for r in (names if parts == 1 else names.where(F.pmod(F.xxhash64("c"), F.lit(parts)) == k)).collect()]
        if block:
            one = finding(block)
            done = one if done is None else done.unionByName(one)
    if done is None:
        done = texts.sparkSession.createDataFrame([], f"concept string, id {kind}")
    return done.select(F.col("concept").alias(concept_col), F.col("id").alias(id_col))
