"""Readers of image data sets that are described by split files, folders or variant lists."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import json_lists
from .corpora import dense_index

SPLITS = ("train", "val", "test")


def read_split_json(spark: SparkSession, path: str, suffix: str = ".json", split: int = json_lists.SPLIT) -> DataFrame:
    """(split, path, label, classname) of {train, val, test: [[path, label, classname], ...]} files, read in byte ranges.

    path: a file, or a folder of files with that suffix.  Other keys are left out; an item that is no list has nulls.
    """
    rows = json_lists.read_json_lists(spark, path, "array<string>", suffix, split).where(F.col("key").isin(*SPLITS))
    r = F.col("value")
    return rows.select(F.col("key").alias("split"), F.get(r, F.lit(0)).alias("path"), F.get(r, F.lit(1)).try_cast("int").alias("label"), F.get(r, F.lit(2)).alias("classname"))


def write_split_json(rows: DataFrame, path: str) -> None:
    """Split files of rows (split, path, label, classname): a JSON object of each Arrow batch, one on each line of text files.

    Rows stay where they are, so a repeated path gathers nowhere.  Rows of another split, or of none, are left out.
    """

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists: dict[str, list] = {s: [] for s in SPLITS}
            for r in batch.to_pylist():
                lists[r["split"]].append([r["path"], r["label"], r["classname"]])
            yield pa.RecordBatch.from_pydict({"value": [json.dumps(lists)]})

    wanted = rows.where(F.col("split").isin(*SPLITS)).select("split", "path", "label", "classname")
    wanted.mapInArrow(told, "value string").write.text(path)


def read_folders(spark: SparkSession, path: str) -> DataFrame:
    """(path, classname, label): images in folders named by class; labels number the sorted class names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    named = files.withColumn("classname", F.element_at(F.split("path", "/"), -2))
    classes = named.select("classname").distinct()
    labels = dense_index(classes, ["classname"], "label").withColumn("label", F.col("label").cast("int"))
    return named.join(labels, "classname").select("path", "classname", "label")


def read_variants(spark: SparkSession, split_file: str, variants_file: str) -> DataFrame:
    """(image_id, classname) of lines "id class words"; class names must be among the variants."""
    rows = spark.read.text(split_file).select(F.split("value", " ", 2).alias("p")).select(F.col("p")[0].alias("image_id"), F.col("p")[1].alias("classname"))
    return rows.join(spark.read.text(variants_file).select(F.col("value").alias("classname")), "classname", "left_semi")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Packaged sets, as Parquet."""
    return spark.read.parquet(path)


#: Data set names by how they are described.
LOADERS: dict[str, Callable[..., DataFrame]] = (
    dict.fromkeys("birdsnap caltech101 caltech256 cub dtd eurosat flowers102 food101 oxfordpets stanfordcars sun397 ucf101".split(), read_split_json)
    | dict.fromkeys("imagenet imagenet-r imagenet-sketch country211 tail290".split(), read_folders)
    | {"fgvcaircraft": read_variants}
    | dict.fromkeys("cifar10 cifar100".split(), read_table)
)


def samples_of(rows: DataFrame) -> DataFrame:
    """(label, paths) of rows (path, label): each label's paths, sorted."""
    return rows.groupBy("label").agg(F.sort_array(F.collect_list("path")).alias("paths"))


def class_list(rows: DataFrame) -> DataFrame:
    """(label, classname) over all splits; a label with two names, or a name with two labels, fails the job that reads it."""
    named = rows.groupBy("label").agg(F.min("classname").alias("classname"), F.max("classname").alias("other"))
    labels = rows.groupBy("classname").agg((F.min("label") < F.max("label")).alias("twice"))
    both = named.join(labels, "classname")
    good = F.when((F.col("classname") == F.col("other")) & ~F.col("twice"), F.col("classname"))
    return both.select("label", F.coalesce(good, F.raise_error(F.concat(F.lit("label "), F.col("label").cast("string"), F.lit(" is not one class")))).alias("classname"))


def load_dataset(name: str) -> Callable[..., DataFrame]:
    """The reader of a named data set; raises on unknown names."""
    if name not in LOADERS:
        raise ValueError(f"unknown data set {name}")
    return LOADERS[name]
