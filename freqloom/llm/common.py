"""What the operators share: shared storage, Arrow batches, a readable null-safe text column."""

from __future__ import annotations

import re
import sys
import tempfile
import types
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows in one batch of a scan or of Arrow data: long texts must fit a task a few times over.
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; also makes checkpoint() usable.

    A cluster names it in spark.checkpoint.dir.  Where that is unset and Spark runs in one process, a
    temporary folder is taken; elsewhere that is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="freqloom-"))
    return (named or sc.getCheckpointDir()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def small_batches(spark: SparkSession) -> None:
    """Keep column batches of scans and Arrow batches small enough for long texts.

    Both are session settings, read when a plan runs.  A scan's default of 4,096 rows would hold that
    many texts in one array.
    """
    for key in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
        if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
            spark.conf.set(key, str(BATCH_ROWS))


def text_bytes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text as bytes): the input of the Arrow operators; a null text is an empty one."""
    small_batches(df.sparkSession)
    return df.select(F.col(id_col), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias(text_col))


def decoded(column: pa.ChunkedArray | pa.Array) -> Iterator[str]:
    return (x.as_py().decode("utf-8", "replace") for x in column)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where df has columns of the same name (case aside)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def whole_text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def once_per_worker(name: str, make: Callable[[], Any]) -> Any:
    """make(), kept in the Python worker for later tasks (functions shipped by value keep no globals)."""
    kept = sys.modules.setdefault("_freqloom_worker", types.ModuleType("_freqloom_worker"))
    if not hasattr(kept, name):
        setattr(kept, name, make())
    return getattr(kept, name)
