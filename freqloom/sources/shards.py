"""Names and ids of the members of tar shards; ``tar`` reads them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".ppm", ".bmp", ".pgm", ".tif", ".tiff", ".webp")


def texts_by_index(members: DataFrame) -> DataFrame:
    """(idx, text) of text members named by a leading integer."""
    return members.select(leading_number(F.col("name")).alias("idx"), F.decode("content", "UTF-8").alias("text")).where("idx IS NOT NULL")


def leading_number(name: Column) -> Column:
    """The integer at the start of the last path part; null without one."""
    return F.regexp_extract(F.element_at(F.split(name, "/"), -1), r"^(\d+)", 1).try_cast("bigint")


def sample_id(name: Column, per_shard: int = 10_000) -> Column:
    """Sample id of ``[folder/]number.jpg``: with a numeric folder (the shard) number + shard * per_shard."""
    stem = F.regexp_replace(name, r"(?i)\.jpg$", "")
    shard = F.regexp_extract(stem, r"(\d+)/\d+$", 1).try_cast("bigint")
    number = F.regexp_extract(stem, r"(\d+)$", 1).try_cast("bigint")
    return F.when(shard.isNull(), number).otherwise(shard * per_shard + number)


def shard_name(shard: Column, width: int = 5) -> Column:
    return F.lpad(shard.cast("string"), width, "0")
