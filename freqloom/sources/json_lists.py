"""JSON lists read in pieces: files that hold one or more arrays or objects are cut into byte ranges, each read by a task.

A range can't know by itself whether it begins inside a string, or how deep.  So each range first tells how many
quotes it holds (odd or even) and how its brackets add up, for a beginning outside and for one inside a string;
sums over the ranges before give the true beginning of each; then ranges are read again and cut at the commas of
the outermost arrays or objects, or of the arrays in an object.  An element belongs to the range of the bracket or
comma before it.

Elements must fit a task; files and arrays may be of any size.  Empty arrays and files have no elements.  A file
that begins with anything but what is asked for, or ends within it, fails the job.  UTF-8, with or without a mark.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from freqloom.functions.text import caption as clean_caption

from .tar import archives, opened

SPLIT, CHUNK, BATCH_BYTES = 128 << 20, 4 << 20, 16 << 20
QUOTE, BACKSLASH, COMMA, OPEN, CLOSE, OPEN_OBJECT, CLOSE_OBJECT = b'"\\,[]{}'
BLANK, MARK = b" \t\r\n", b"\xef\xbb\xbf"
STRING = re.compile(rb'"(?:[^"\\]|\\.)*"\Z', re.DOTALL)
#: What is cut: (first byte of a file, brackets around elements, their depth).
ARRAYS, OBJECTS, LISTS = (OPEN, OPEN, CLOSE, 1), (OPEN_OBJECT, OPEN_OBJECT, CLOSE_OBJECT, 1), (OPEN_OBJECT, OPEN, CLOSE, 2)


def backslashes(file: Any, at: int) -> int:
    """How many backslashes stand right before a position."""
    n = 0
    while at > 0:
        start = max(0, at - 4096)
        file.seek(start)
        piece = file.read(at - start)
        kept = len(piece.rstrip(b"\\"))
        n += len(piece) - kept
        if kept:
            break
        at = start
    return n


def marks(b: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes are quotes that begin or end a string, and the brackets' signs; before: backslashes before the first byte."""
    at = np.arange(len(b))
    other = np.maximum.accumulate(np.where(b != BACKSLASH, at, -1))  # the last byte that is none
    run = np.empty(len(b), np.int64)  # backslashes right before each byte
    run[0] = before
    run[1:] = at[:-1] - other[:-1] + np.where(other[:-1] < 0, before, 0)
    quote = (b == QUOTE) & (run % 2 == 0)
    sign = ((b == OPEN) | (b == OPEN_OBJECT)).astype(np.int64) - ((b == CLOSE) | (b == CLOSE_OBJECT))
    return quote, sign


def chunks(file: Any, start: int, end: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(position, bytes, quotes, signs) of the chunks of a range."""
    while start < end:
        before = backslashes(file, start)
        file.seek(start)
        b = np.frombuffer(file.read(min(CHUNK, end - start)), np.uint8)
        if not len(b):
            return
        yield start, b, *marks(b, before)
        start += len(b)


def summed(file: Any, start: int, end: int) -> tuple[int, int, int]:
    """(odd number of quotes, sum of brackets if the range begins outside a string, and inside)."""
    odd, outside, inside = 0, 0, 0
    for _, _, quote, sign in chunks(file, start, end):
        within = (np.cumsum(quote) + odd) % 2 == 1
        outside += int(sign[~within].sum())
        inside += int(sign[within].sum())
        odd = (odd + int(quote.sum())) % 2
    return odd, outside, inside


def key_before(file: Any, at: int) -> str:
    """The key of the value that begins at a position."""
    held = 256
    while True:
        start = max(0, at - held)
        file.seek(start)
        piece = file.read(at - start).rstrip(BLANK)
        name = STRING.search(piece[:-1].rstrip(BLANK)) if piece.endswith(b":") else None
        # a quote within a string has a backslash before it; the one that begins a key follows a brace or comma
        if name is not None and piece[: name.start()].rstrip(BLANK).endswith((b"{", b",")):
            return json.loads(name[0])
        if start == 0:
            raise ValueError("a JSON list has an array without a key")
        held *= 4


def last_key(file: Any, start: int, end: int, odd: int, depth: int) -> str | None:
    """The key of the last array that begins in a range; anything but objects of arrays and plain values fails."""
    last = None
    for at, b, quote, sign in chunks(file, start, end):
        count = np.cumsum(quote) + odd
        clear = count % 2 == 0
        deep = depth + np.cumsum(np.where(clear, sign, 0))
        if (clear & (((b == OPEN_OBJECT) & (deep == 2)) | ((b == OPEN) & (deep == 1)))).any():
            raise ValueError("a JSON list must be an object of arrays")
        found = np.flatnonzero(clear & (b == OPEN) & (deep == 2))
        if len(found):
            last = at + int(found[-1])
        odd, depth = int(count[-1]) % 2, int(deep[-1])
    return None if last is None else key_before(file, last)


def elements(file: Any, start: int, end: int, size: int, odd: int, depth: int, kind: tuple[int, int, int, int] = ARRAYS) -> Iterator[tuple[int, bytes, bool]]:
    """(position of the bracket or comma before it, element, whether that is a bracket) of those that a range owns."""
    head_byte, begin, finish, level = kind
    if start == 0:
        file.seek(0)
        head = file.read(4096).removeprefix(MARK).lstrip(BLANK)
        if head and head[0] != head_byte:
            raise ValueError(f"a JSON list must begin with {chr(head_byte)}")
    opener, first = None, False
    for at, b, quote, sign in chunks(file, start, size):
        count = np.cumsum(quote) + odd
        clear = count % 2 == 0
        deep = depth + np.cumsum(np.where(clear, sign, 0))
        if deep.min() < 0:
            raise ValueError("a JSON list closes more than it opens")
        cuts = clear & (((b == COMMA) & (deep == level)) | ((b == begin) & (deep == level)) | ((b == finish) & (deep == level - 1)))
        for i in np.flatnonzero(cuts).tolist():
            if opener is not None:
                file.seek(opener + 1)
                text = file.read(at + i - opener - 1).strip(BLANK)
                if text:
                    yield opener, text, first
            if at + i >= end:
                return
            opener, first = None if b[i] == finish else at + i, bool(b[i] == begin)
        odd, depth = int(count[-1]) % 2, int(deep[-1])
        if at + len(b) >= end and opener is None:
            break
    if opener is not None or (end >= size and (odd or depth)):
        raise ValueError("a JSON list ends within an array")


def read_elements(spark: SparkSession, path: str, suffix: str = ".json", split: int = SPLIT, kind: tuple[int, int, int, int] = ARRAYS) -> DataFrame:
    """(file, at, key, element) of the arrays of a file, or of all files in a folder: each element's text and its place.

    kind: ARRAYS; OBJECTS, whose elements are texts ``"key": value``; or LISTS, objects of arrays, whose elements
    are those of the arrays, each with the key of its array (of the other kinds, key is null).  The driver lists
    files and cuts ranges only.
    """
    ranges = [(f, start, min(n, start + split), n) for f, n in archives(path, suffix) for start in range(0, n, split)]
    parts = max(1, len(ranges))
    listed = spark.createDataFrame(ranges, "file string, start long, end long, size long").repartition(parts, "file", "start")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                with opened(r["file"]) as file:
                    odd, outside, inside = summed(file, r["start"], r["end"])
                rows.append(r | {"odd": odd, "outside": outside, "inside": inside})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("file", pa.string()), *((c, pa.int64()) for c in ("start", "end", "size", "odd", "outside", "inside"))]))

    told = listed.mapInArrow(scan, "file string, start long, end long, size long, odd long, outside long, inside long")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    parity = told.withColumn("odd", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    deep = F.sum(F.when(F.col("odd") == 0, F.col("outside")).otherwise(F.col("inside"))).over(before)
    begun = parity.select("file", "start", "end", "size", "odd", F.coalesce(deep, F.lit(0)).alias("depth")).repartition(parts, "file", "start")
    state = "file string, start long, end long, size long, odd long, depth long, key string"

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                with opened(r["file"]) as file:
                    rows.append(r | {"key": last_key(file, r["start"], r["end"], r["odd"], r["depth"])})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("file", pa.string()), *((c, pa.int64()) for c in ("start", "end", "size", "odd", "depth")), ("key", pa.string())]))

    if kind == LISTS:
        named = begun.mapInArrow(name, state).withColumn("key", F.last("key", ignorenulls=True).over(before))
        begun = named.repartition(parts, "file", "start")
    else:
        begun = begun.withColumn("key", F.lit(None).cast("string"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(name: str, held: list[tuple[int, str | None, str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name] * len(held), pa.string()), pa.array([a for a, _, _ in held], pa.int64()), *(pa.array([h[k] for h in held], pa.string()) for k in (1, 2))], ["file", "at", "key", "element"])

        for batch in batches:
            for r in batch.to_pylist():
                held, size, key = [], 0, r["key"]
                with opened(r["file"]) as file:
                    for at, text, first in elements(file, r["start"], r["end"], r["size"], r["odd"], r["depth"], kind):
                        if first and kind == LISTS:
                            key = key_before(file, at)
                        held.append((at, key, text.decode()))
                        size += len(text)
                        if size >= BATCH_BYTES:
                            yield batch_of(r["file"], held)
                            held, size = [], 0
                yield batch_of(r["file"], held)

    return begun.mapInArrow(read, "file string, at long, key string, element string")


def read_json_list(spark: SparkSession, path: str, schema: str, suffix: str = ".json", split: int = SPLIT) -> DataFrame:
    """(file, at, the fields of schema) of the objects in JSON arrays; one that doesn't parse has nulls."""
    found = read_elements(spark, path, suffix, split)
    return found.select("file", "at", F.from_json("element", schema).alias("e")).select("file", "at", "e.*")


def read_json_map(spark: SparkSession, path: str, value: str, suffix: str = ".json", split: int = SPLIT) -> DataFrame:
    """(file, at, key, value) of the entries of JSON objects, values of a type; one that doesn't parse has nulls."""
    found = read_elements(spark, path, suffix, split, OBJECTS)
    entry = F.from_json(F.concat(F.lit("{"), "element", F.lit("}")), f"map<string, {value}>")
    return found.select("file", "at", F.map_entries(entry)[0].alias("e")).select("file", "at", "e.key", "e.value")


def read_json_lists(spark: SparkSession, path: str, value: str, suffix: str = ".json", split: int = SPLIT) -> DataFrame:
    """(file, at, key, value) of the elements of the arrays in JSON objects {key: [value, ...]}; one that doesn't parse is null."""
    found = read_elements(spark, path, suffix, split, LISTS)
    wrapped = F.from_json(F.concat(F.lit('{"v": '), "element", F.lit("}")), f"v {value}")
    return found.select("file", "at", "key", wrapped["v"].alias("value"))


#: Fixed value: the fields of an annotation list.
ANNOTATION = "image_path string, caption array<string>, union_label_id array<long>, parse_label_id array<array<long>>"


def annotations(rows: DataFrame, words: int = 30) -> DataFrame:
    """(image_path, pos, caption, image_tags, caption_tags): each caption of annotated images, cleaned, with the tags of image and caption."""
    each = rows.select("image_path", F.posexplode("caption").alias("pos", "caption"), "union_label_id", "parse_label_id")
    return each.select("image_path", "pos", clean_caption(F.col("caption"), words).alias("caption"), F.col("union_label_id").alias("image_tags"), F.get("parse_label_id", F.col("pos")).alias("caption_tags"))


def one_caption(rows: DataFrame, seed: int = 0) -> DataFrame:
    """The same with one caption of each image, the one with the least hash for the seed: another epoch takes another seed."""
    place = F.struct(F.xxhash64("image_path", "pos", F.lit(seed)), "pos")
    first = F.min_by(F.struct("pos", "caption", "image_tags", "caption_tags"), place)
    return annotations(rows).groupBy("image_path").agg(first.alias("e")).select("image_path", "e.*")


def multi_hot(tags: Column, classes: int) -> Column:
    """An array of ``classes`` numbers, 1 at the tags."""
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.array_contains(tags, i.cast("long")).cast("int"))
