"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


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


def dealt(df: DataFrame, *keys: Column | str, groups: int = 1) -> DataFrame:
    """df by its keys in the session's number of shuffle partitions, which adaptive execution doesn't merge into large ones.

    groups: the one key is a number below it, and no partition holds rows of two of them; a group's rows are
    spread over partitions by all their columns.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if groups == 1:
        return df.repartition(n, *keys)
    each = max(1, n // groups)
    return df.repartitionById(groups * each, (keys[0] * each + F.pmod(F.xxhash64(*df.columns), F.lit(each))).cast("int"))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there, so that later reads see the same rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
