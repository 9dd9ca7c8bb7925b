"""Readers of caption corpora and of the files around them, each with an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import cut

#: Column order of each corpus's files.
TSV_COLUMNS = {"cc3m": "text STRING, link STRING", "cc12m": "link STRING, text STRING", "yfcc15m": "link STRING, text STRING"}
PARQUET_COLUMNS = {"laion400m": ("caption", "url"), "laion2b": ("TEXT", "URL")}
REWRITTEN_COLUMNS = "image STRING, text STRING, link STRING"


def read_captions(spark: SparkSession, name: str, path: str) -> DataFrame:
    """(link, text) rows of a named corpus; rows of Parquet corpora without caption or link are left out."""
    if name in TSV_COLUMNS:
        return spark.read.csv(path, sep="\t", schema=TSV_COLUMNS[name], quote="").select("link", "text")
    if name in PARQUET_COLUMNS:
        text, link = PARQUET_COLUMNS[name]
        return drop_missing(spark.read.parquet(path).select(F.col(link).alias("link"), F.col(text).alias("text")), ["link", "text"])
    raise ValueError(f"unknown corpus {name}")


def drop_missing(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Empty strings become null; rows with a null in one of the columns go."""
    return rows.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in columns}).dropna(subset=columns)


def dense_index(rows: DataFrame, order: list[str], out: str = "idx") -> DataFrame:
    """Number rows from 0 in the order of columns, without a single-task sort of the rows.

    Rows are range-partitioned and sorted once; each partition's count shifts its local numbers.  Ties
    of the order columns must not matter to the caller.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = placed.withColumn("__part", F.shiftright("__at", 33)).withColumn("__nth", F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at")
    placed = cut(placed)  # the partition number is used twice and must not change
    sizes = placed.groupBy("__part").agg(F.max("__nth").alias("n"))
    before = F.coalesce(F.sum(F.col("n") + 1).over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", before.alias("__before"))  # one row for each partition
    return placed.join(F.broadcast(offsets), "__part").withColumn(out, (F.col("__before") + F.col("__nth")).cast("long")).drop("__part", "__nth", "__before")


def replace_by_position(rows: DataFrame, lines: DataFrame, order: list[str], line_order: list[str], check: bool = True, same: tuple[str, str] | None = None) -> DataFrame:
    """rows with column text replaced by the line at the same position; lengths must match if checked.

    same: columns of rows and of lines that must be equal at each position; a row where they are not
    fails the job that reads it.
    """
    own = [] if same is None else [F.col(same[1]).alias("__same")]
    a, b = dense_index(rows, order), dense_index(lines, line_order).select("idx", F.col("line").alias("__line"), *own)
    if check and (n := rows.count()) != (m := lines.count()):
        raise ValueError(f"{n} rows and {m} lines")
    line = F.col("__line")
    if same is not None:
        line = F.when(F.col(same[0]).eqNullSafe(F.col("__same")), line).otherwise(F.raise_error(F.concat(F.lit("other id at position "), F.col("idx").cast("string"))))
    return a.join(b, "idx").withColumn("text", line).drop("__line", "__same")


def chunk(rows: DataFrame, total: int, chunks: int, index: str = "idx") -> DataFrame:
    """chunk_id by position: slices of total // chunks + 1 rows."""
    return rows.withColumn("chunk_id", F.floor(F.col(index) / (total // chunks + 1)).cast("long"))


def flatten_captions(images: DataFrame, id_col: str, captions: str, most: int = 5) -> DataFrame:
    """(id, pos, caption): the first ``most`` captions of each image."""
    return images.select(id_col, F.posexplode(F.slice(captions, 1, most)).alias("pos", "caption"))


def first_captions(rows: DataFrame, id_col: str, order: list[str], caption: str, most: int = 5) -> DataFrame:
    """(id, pos, caption): the first ``most`` rows of each id in the given order, numbered from 0.

    Each task keeps its first rows of an id before they are shuffled (window group limit).
    """
    nth = F.row_number().over(Window.partitionBy(id_col).orderBy(*order))
    return rows.withColumn("__nth", nth).where(F.col("__nth") <= most).select(id_col, (F.col("__nth") - 1).alias("pos"), F.col(caption).alias("caption"))


def concept_keys(results: DataFrame, json_col: str) -> DataFrame:
    """Concepts of result trees {model: {..., classwise|conceptwise: {concept: value}}}; the empty concept is left out."""
    tree = F.from_json(json_col, "map<string, struct<classwise: map<string, string>, conceptwise: map<string, string>>>")
    maps = results.select(F.explode(F.map_values(tree)).alias("t")).select(F.explode(F.map_keys(F.coalesce("t.classwise", "t.conceptwise"))).alias("concept"))
    return maps.where(F.col("concept") != "").distinct()


def first_keys(lists: DataFrame, json_col: str) -> DataFrame:
    """Concepts of a list of one-key objects: the first key of each."""
    items = lists.select(F.explode(F.from_json(json_col, "array<map<string, array<string>>>")).alias("m"))
    return items.select(F.map_keys("m")[0].alias("concept")).where("concept <> ''")


def url_rows(rows: DataFrame, url: str, order: list[str]) -> DataFrame:
    """(url, row_idx): position of each url in the corpus."""
    return dense_index(rows.select(*dict.fromkeys([url, *order])), order, "row_idx")


def one_hot(rows: DataFrame, label: str, classes: int, out: str = "bits") -> DataFrame:
    return rows.withColumn(out, F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: (i == F.col(label)).cast("int")))
