"""Line de-duplication over levelled sorted runs of line hashes.

Every batch of documents becomes one *run*: a table of (key, docs, ids) rows, one per line key of the
batch, bucketed and sorted by key.  A level that holds ``FANOUT`` runs is compacted into one run of the
next level.  A batch is judged before its run is added: its keys are merge-joined with the runs, in
which those that no run holds (the anti-join) find nothing, and no run is moved.

A key that is not yet frequent keeps the ids of the few documents that hold it; a frequent one keeps its
largest only.  So whenever a key becomes frequent, or a frequent one gets a larger id, the documents
that lose its lines are known from the batch and the runs alone.  Batches may come in any order, and
what they lose together is what all documents at once would.

Keys are the first 16 bytes of a SHA-256, so two different lines share one with negligible probability.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, free_names, shared_dir, small_batches, text_bytes

MIN_CHARS, MIN_DOCS = 20, 3
BATCHES, FANOUT = 4, 3
#: Rows of (document, key) pairs for each bucket of a run, up to Spark's own limit of buckets.
BUCKET_PAIRS, MAX_BUCKETS = 500_000, 100_000
#: Keys with over 1 / HEAVY of a batch's (document, key) pairs, at most HEAVY of them, are joined by broadcast.
HEAVY = 1024
BLANKS = b" \t\n\x0b\x0c\r"
NO_ID = -(1 << 63)


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key's hash, or None for a key of fewer than min_chars code points."""
    key = line.strip(BLANKS).lower()
    if len(key) < min_chars or (not key.isascii() and sum(x & 0xC0 != 0x80 for x in key) < min_chars):
        return None
    return hashlib.sha256(key).digest()[:16]


def line_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(doc, key): a row for each distinct key of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = {line_key(x, min_chars) for x in text.as_py().split(b"\n")} - {None}
                ids += [doc] * len(own)
                keys += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["doc", "key"])

    src = text_bytes(docs, id_col, text_col)
    src = src.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), text_col)
    return src.mapInArrow(run, "doc long, key binary")


class LineRuns:
    """The levelled runs, as bucketed tables whose files are in the shared folder, wherever the warehouse is.

    A key counts as frequent from ``min_docs`` documents on.
    """

    def __init__(self, spark: SparkSession, buckets: int, min_docs: int = MIN_DOCS, fanout: int = FANOUT) -> None:
        self.spark, self.buckets, self.min_docs, self.fanout = spark, buckets, min_docs, fanout
        self.levels: list[list[str]] = []

    def names(self) -> list[str]:
        return [x for level in self.levels for x in level]

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        dealt = rows.repartition(self.buckets, "key") if self.buckets > 1 else rows.coalesce(1)
        dealt.write.bucketBy(self.buckets, "key").sortBy("key").option("path", self._path(name)).saveAsTable(name)
        return name

    def _path(self, name: str) -> str:
        return f"{shared_dir(self.spark)}/{name}"

    def _drop(self, name: str) -> None:
        """The table and, since they have a path of their own, its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def matched(self, keys: DataFrame) -> DataFrame:
        """keys with (before, known): documents counted in the runs, and the ids kept there; 0 and none for a key that no run holds."""
        dealt = keys.repartition(self.buckets, "key") if self.buckets > 1 else keys.coalesce(1)
        before, known = F.lit(0).cast("long"), F.array().cast("array<long>")
        for k, name in enumerate(self.names()):
            run = self.spark.table(name).select("key", F.col("docs").alias(f"docs{k}"), F.col("ids").alias(f"ids{k}"))
            dealt = dealt.join(run.hint("merge"), "key", "left")
            before, known = before + F.coalesce(f"docs{k}", F.lit(0)), F.concat(known, F.coalesce(f"ids{k}", F.array().cast("array<long>")))
        return dealt.select(*keys.columns, before.alias("before"), known.alias("known"))

    def add(self, batch: DataFrame) -> DataFrame:
        """Judge a batch of (doc, key) rows and add its run; a document's rows must come in one batch.

        Gives (doc, key), the lines lost that were not lost before: the batch's own, and those of
        documents of earlier batches.
        """
        pairs = cut(batch.select("key", "doc").distinct())
        rows = pairs.count()
        counts = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.max("doc").alias("last"))
        judged = cut(self.matched(counts).withColumn("top", F.greatest("last", F.array_max("known"))))
        now = F.col("before") + F.col("docs")
        frequent = judged.where(now >= self.min_docs)
        heavy = F.broadcast(frequent.where(F.col("docs") * HEAVY > rows).select("key", "top"))
        light = frequent.where(F.col("docs") * HEAVY <= rows).select("key", "top")
        own = pairs.join(heavy, "key").unionByName(pairs.join(heavy.select("key"), "key", "left_anti").join(light, "key"))
        # Of a key that was frequent before, all but the largest id have lost their lines already.
        waiting = F.when(F.col("before") < self.min_docs, F.col("known")).otherwise(F.slice(F.sort_array("known", False), 1, 1))
        earlier = frequent.where("before > 0").select("key", F.explode(waiting).alias("doc"), "top")
        lost = cut(own.unionByName(earlier).where("doc < top").select("doc", "key"))
        rare = judged.where(F.col("docs") < self.min_docs).select("key", "docs")
        few = pairs.join(rare, "key").groupBy("key", "docs").agg(F.collect_list("doc").alias("ids"))  # under min_docs ids each
        many = judged.where(F.col("docs") >= self.min_docs).select("key", "docs", F.array("last").alias("ids"))
        self._put(0, self._write(few.unionByName(many)))
        return lost

    def _put(self, level: int, name: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            self.compact(level)

    def compact(self, level: int) -> None:
        """Merge a level's runs into one run of the next level."""
        old, self.levels[level] = self.levels[level], []
        merged = self._write(self._merge(old))
        for name in old:
            self._drop(name)
        self._put(level + 1, merged)

    def _merge(self, names: list[str]) -> DataFrame:
        """One row per key, by full outer merge joins of runs that share their buckets."""
        none = F.array().cast("array<long>")
        merged = self.spark.table(names[0]).select("key", "docs", "ids")
        for name in names[1:]:
            more = self.spark.table(name).select("key", F.col("docs").alias("docs2"), F.col("ids").alias("ids2"))
            both = merged.join(more, "key", "full")
            merged = both.select("key", (F.coalesce("docs", F.lit(0)) + F.coalesce("docs2", F.lit(0))).alias("docs"), F.concat(F.coalesce("ids", none), F.coalesce("ids2", none)).alias("ids"))
            merged = merged.withColumn("ids", F.when(F.col("docs") >= self.min_docs, F.array(F.array_max("ids"))).otherwise(F.col("ids")))
        return merged

    def frequent(self) -> DataFrame:
        """(key, docs, top) of the frequent keys of all batches."""
        if not self.names():
            return self.spark.createDataFrame([], "key binary, docs long, top long")
        return self._merge(self.names()).where(F.col("docs") >= self.min_docs).select("key", "docs", F.array_max("ids").alias("top"))

    def drop(self) -> None:
        for name in self.names():
            self._drop(name)
        self.levels = []


def lost_keys(keys: DataFrame, min_docs: int, batches: int) -> DataFrame:
    """(doc, keys array): the keys whose lines each document loses; keys: (doc, key) in shared storage."""
    buckets = min(MAX_BUCKETS, 1 + keys.count() // BUCKET_PAIRS)
    runs = LineRuns(keys.sparkSession, buckets, min_docs)
    try:
        lost = [runs.add(keys.where(F.pmod(F.xxhash64("doc"), F.lit(batches)) == i)) for i in range(batches)]
    finally:
        runs.drop()
    return reduce(DataFrame.unionByName, lost).groupBy("doc").agg(F.collect_set("key").alias("keys"))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """docs with the repeated lines taken out of the text, and (__n_lines, __n_dropped) at the end.

    A line's key is the line without blanks at its ends and with A-Z lower-cased.  Keys of at least
    min_chars code points found in at least min_docs documents lose their lines everywhere but in the
    largest id that holds them.  A null or empty text is one empty line.  Rows with one id are one
    document, so repeated rows count once and share their fate; a null id is smaller than any other.
    Other columns pass through unchanged, whatever their names (where one has the name of an added
    column, that gets underscores); an empty table gives no rows.
    """
    keys = cut(line_keys(docs, id_col, text_col, min_chars))
    lost = lost_keys(keys, min_docs, batches)
    small_batches(docs.sparkSession)
    doc, gone_col, found_col, dropped_col = free_names(docs, "__doc", "__keys", "__n_lines", "__n_dropped")
    src = docs.withColumn(text_col, F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))).withColumn(doc, F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)))
    src = src.join(lost.select(F.col("doc").alias(doc), F.col("keys").alias(gone_col)), doc, "left").select(*docs.columns, gone_col)
    at, out = docs.columns.index(text_col), T.StructType([*(T.StructField(f.name, T.BinaryType() if f.name == text_col else f.dataType) for f in docs.schema), T.StructField(found_col, T.LongType()), T.StructField(dropped_col, T.LongType())])

    def run(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces:
            texts, found, dropped = [], [], []
            for text, gone in zip(piece.column(at).to_pylist(), piece.column(piece.num_columns - 1).to_pylist()):
                n = text.count(b"\n") + 1
                found.append(n)
                if gone:
                    gone = set(gone)
                    kept = [x for x in text.split(b"\n") if (key := line_key(x, min_chars)) is None or key not in gone]
                    text, n = b"\n".join(kept), n - len(kept)
                else:
                    n = 0
                texts.append(text)
                dropped.append(n)
            columns = [pa.array(texts, pa.binary()) if k == at else piece.column(k) for k in range(piece.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.int64()), pa.array(dropped, pa.int64())], out.names)

    return src.mapInArrow(run, out).withColumn(text_col, F.col(text_col).cast("string"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """(id, n_lines, n_dropped, text) for each row; see drop_lines."""
    done = drop_lines(docs.select(id_col, text_col), id_col, text_col, **options)
    return done.select(id_col, F.col(done.columns[-2]).alias("n_lines"), F.col(done.columns[-1]).alias("n_dropped"), text_col)
