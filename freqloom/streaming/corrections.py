"""An index that follows its documents: changes and removals correct the postings written before.

Each micro-batch is joined with the documents' last versions and terms.  A newer version is kept with the terms
it has and those before it, and gives a row (term, sample_id, 1) for each term it gains and -1 for each it loses;
an older or equal version gives nothing, so a document that is sent again counts once.  Both are a run; ``fan``
runs of a level are merged into one of the next, document by document: it goes from the terms before the first
to those of the last, so rows that cancel out are gone.  A manifest for each micro-batch names the runs that
count.  A batch that is repeated after a failure writes the same names again from the manifest before it, and
readers see a batch whole or not at all.  Merged runs stay on disk, for readers that still use them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from freqloom.operators.index import Analyzer, surface

DOCUMENT = "sample_id long, version long, text string"
FOLLOWED = "sample_id long, version long, terms array<string>, before array<string>"
CHANGE = "term string, sample_id long, change int"
MANIFEST = "level int, run string"


def newest(documents: DataFrame, analyzer: Analyzer = surface) -> DataFrame:
    """(sample_id, version, terms) of each document's newest version among rows of (sample_id, version, text).

    A null text, or one without terms, removes the document; its version is kept, so that a late older one
    does not bring it back.  Of rows with one version the greatest list of terms counts; rows without an id
    or a version are left out.
    """
    terms = F.sort_array(F.array_distinct(analyzer(F.col("text"))))
    rows = documents.where("sample_id IS NOT NULL AND version IS NOT NULL").select("sample_id", "version", terms.alias("terms"))
    return rows.groupBy("sample_id").agg(F.max(F.struct("version", "terms")).alias("x")).select("sample_id", "x.version", "x.terms")


def followed(new: DataFrame, held: DataFrame | None) -> DataFrame:
    """(sample_id, version, terms, before) of the documents of new that are newer than those of held, or not there; before: the terms until now."""
    none = F.array().cast("array<string>")
    if held is None:
        return new.withColumn("before", none)
    old = held.select("sample_id", F.col("version").alias("last"), F.col("terms").alias("before"))
    met = new.join(old, "sample_id", "left").where("last IS NULL OR version > last")
    return met.select("sample_id", "version", "terms", F.coalesce("before", none).alias("before"))


def changes(documents: DataFrame) -> DataFrame:
    """(term, sample_id, change) of followed documents: 1 for each term gained, -1 for each lost."""
    each = documents.select("sample_id", F.array_except("terms", "before").alias("gained"), F.array_except("before", "terms").alias("lost"))
    rows = each.select("sample_id", F.size("gained").alias("n"), F.posexplode(F.concat("gained", "lost")).alias("pos", "term"))
    return rows.select("term", "sample_id", F.when(F.col("pos") < F.col("n"), 1).otherwise(-1).alias("change"))


def documents(spark: SparkSession, target: str, runs: list[str]) -> DataFrame | None:
    """The followed documents of several runs together: the newest version's terms, those before the oldest; None without runs."""
    if not runs:
        return None
    read = spark.read.schema(FOLLOWED).parquet(*[f"{target}/documents/{r}" for r in runs])
    if len(runs) == 1:  # a document is once in a run
        return read
    both = read.groupBy("sample_id").agg(F.max(F.struct("version", "terms")).alias("x"), F.min(F.struct("version", "before")).alias("y"))
    return both.select("sample_id", "x.version", "x.terms", "y.before")


def write_run(rows: DataFrame, target: str, name: str) -> None:
    """Followed documents and the changes they make, as a run."""
    rows.write.mode("overwrite").parquet(f"{target}/documents/{name}")
    changes(documents(rows.sparkSession, target, [name])).write.mode("overwrite").parquet(f"{target}/runs/{name}")


def merged(spark: SparkSession, target: str, runs: list[str]) -> DataFrame:
    """(term, sample_id, change) of several runs together, without rows that cancel out."""
    read = spark.read.schema(CHANGE).parquet(*[f"{target}/runs/{r}" for r in runs])
    if len(runs) == 1:  # a term of a document is once in a run
        return read
    return read.groupBy("term", "sample_id").agg(F.sum("change").cast("int").alias("change")).where("change <> 0")


def manifest(spark: SparkSession, target: str, before: int | None = None) -> list[tuple[int, str]]:
    """(level, run) of the runs that count after the last batch, or after the last one before a number."""
    found = spark.read.schema(f"{MANIFEST}, batch long").parquet(f"{target}/manifest")
    if before is not None:
        found = found.where(F.col("batch") < before)
    last = found.agg(F.max("batch")).head()[0]
    return sorted((r.level, r.run) for r in found.where(F.col("batch") == last).collect())  # a few for each level


def maintain(spark: SparkSession, source: str, target: str, checkpoint: str, analyzer: Analyzer = surface, fan: int = 4) -> StreamingQuery:
    """Start a query that reads new Parquet files of (sample_id, version, text) once each and corrects the index.

    A target belongs to one checkpoint.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        runs = manifest(spark, target, number) if number else []
        held = documents(spark, target, [r for _, r in runs])
        name = f"{number}-0"
        write_run(followed(newest(batch, analyzer), held), target, name)
        runs.append((0, name))
        level = 0
        while len(full := [r for at, r in runs if at == level]) >= fan:
            name = f"{number}-{level + 1}"
            write_run(documents(spark, target, full), target, name)
            runs = [x for x in runs if x[0] != level] + [(level + 1, name)]
            level += 1
        spark.createDataFrame(runs, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{target}/manifest/batch={number}")

    rows = spark.readStream.schema(DOCUMENT).parquet(source)
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def postings(spark: SparkSession, target: str) -> DataFrame:
    """(term, sample_id) of the documents as they are now."""
    return merged(spark, target, [r for _, r in manifest(spark, target)]).where("change > 0").select("term", "sample_id")
