"""Tar archives as a Spark data source: byte ranges of archives are partitions, members are read one by one.

``spark.dataSource.register(TarDataSource)``, then ``spark.read.format("tar").option("path", ...)``.  Options:

* ``path``: a folder or one archive; ``suffix``: of archives in a folder (``.tar``);
* ``split``: bytes of a partition (128 MiB).  A member belongs to the range in which its header begins;
* ``starts``: Parquet written from ``range_starts``: a task walks the headers of its own range, which reads
  512 bytes a member and no contents.  ``read_members`` makes it; without it a task walks from the archive's start;
* ``index``: Parquet written from ``tar_index``, in place of headers;
* ``archives``, ``names``: endings of archives' paths and of members' names, any of which must fit, lower case
  aside, separated by commas: other archives have no partitions, other members aren't read;
* ``tolerant``: a truncated archive ends at the break (true) or raises (false).

The driver lists files and cuts ranges only.  Filters are options and not taken from the query: two
branches of a plan may share one reader.
"""

from __future__ import annotations

import sys
import tarfile
import uuid
from collections.abc import Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .shards import IMAGE_EXTENSIONS
from .storage import shared_dir

cloudpickle.register_pickle_by_value(sys.modules["freqloom"])

SCHEMA = "archive string, name string, size long, content binary"
SPLIT, BATCH_BYTES = 128 << 20, 16 << 20


class Member(NamedTuple):
    """Where a file of an archive begins: its header and its contents."""

    name: str
    at: int
    data: int
    size: int


def opened(path: str) -> Any:
    """A seekable file of any file system that pyarrow knows."""
    from pyarrow import fs

    where, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:/") else f"file://{path}")
    return where.open_input_file(inner)


def archives(path: str, suffix: str) -> list[tuple[str, int]]:
    """(path, bytes) of an archive, or of those in a folder and the folders in it."""
    from pyarrow import fs

    uri = path if "://" in path or path.startswith("file:/") else f"file://{path}"
    where, inner = fs.FileSystem.from_uri(uri)
    info = where.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = [x for x in where.get_file_info(fs.FileSelector(inner, recursive=True)) if x.type == fs.FileType.File and x.path.endswith(suffix)]
    front = uri[: len(uri) - len(inner)] if uri.endswith(inner) else "file://"
    return sorted((front + x.path, x.size) for x in found)


def headers(file: Any, tolerant: bool, start: int = 0) -> Iterator[tuple[tarfile.TarInfo, bool]]:
    """The headers of an archive from one on, and whether headers before it hold for it."""
    file.seek(0, 2)
    size = file.tell()
    file.seek(start)
    try:
        with tarfile.open(fileobj=file, mode="r:") as tar:
            for m in tar:
                tar.members = []  # else it keeps every header
                if m.isfile():
                    if m.offset_data + m.size > size:
                        raise tarfile.ReadError("the archive ends in a member")
                yield m, bool(tar.pax_headers)
            if 0 < size - tar.offset < tarfile.BLOCKSIZE:
                raise tarfile.ReadError("the archive ends in a header")
    except (tarfile.ReadError, EOFError):
        if not tolerant:
            raise


def members(file: Any, tolerant: bool, start: int = 0) -> Iterator[Member]:
    """The regular files of an archive, by its headers alone, from a header on."""
    for m, _ in headers(file, tolerant, start):
        if m.isfile():
            yield Member(m.name, m.offset, m.offset_data, m.size)


def endings(option: str) -> tuple[str, ...]:
    return tuple(x.strip().lower() for x in option.split(",") if x.strip()) or ("",)


class Range(InputPartition):
    """first: a header at which to begin, at or before the range's own; None: no header is in the range."""

    def __init__(self, archive: str, start: int, end: int, first: int | None = 0) -> None:
        super().__init__((archive, start, end, first))
        self.archive, self.start, self.end, self.first = archive, start, end, first


class TarReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.suffix = options["path"], options.get("suffix", ".tar")
        self.split, self.index, self.starts = int(options.get("split", SPLIT)), options.get("index"), options.get("starts")
        self.tolerant = options.get("tolerant", "true").lower() == "true"
        self.archives, self.names = (endings(options.get(x, "")) for x in ("archives", "names"))

    def partitions(self) -> list[Range]:
        wanted = [(a, n) for a, n in archives(self.path, self.suffix) if a.lower().endswith(self.archives)]
        first: dict[tuple[str, int], int] = {}
        if self.starts is not None:
            import pyarrow.parquet as pq
            from pyarrow import fs

            for path, _ in archives(self.starts, ".parquet"):
                where, inner = fs.FileSystem.from_uri(path)
                for x in pq.read_table(inner, filesystem=where).to_pylist():
                    first[(x["archive"], x["range"])] = x["first"]
        walked = {a for a, _ in first}
        return [Range(a, k * self.split, min(n, (k + 1) * self.split), first.get((a, k)) if a in walked else 0) for a, n in wanted for k in range(-(-n // self.split))]

    def found(self, part: Range, file: Any) -> Iterator[Member]:
        if self.index is None:
            if part.first is None:
                return
            for m in members(file, self.tolerant, part.first):
                if m.at >= part.end:
                    return
                if m.at >= part.start:
                    yield m
            return
        import pyarrow.dataset as ds

        held = ds.dataset(self.index, format="parquet")
        wanted = (ds.field("archive") == part.archive) & (ds.field("at") >= part.start) & (ds.field("at") < part.end)
        for batch in held.to_batches(filter=wanted, columns=["name", "at", "data", "size"]):
            yield from (Member(*x) for x in zip(*(c.to_pylist() for c in batch.columns)))

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # there is no archive
            return
        rows: list[tuple] = []
        held = 0
        kinds = (pa.string(), pa.string(), pa.int64(), pa.binary())

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["archive", "name", "size", "content"])

        with opened(part.archive) as file, opened(part.archive) as contents:
            for m in self.found(part, file):
                if m.name.lower().endswith(self.names):
                    contents.seek(m.data)
                    rows.append((part.archive, m.name, m.size, contents.read(m.size)))
                    held += m.size
                    if held >= BATCH_BYTES:
                        yield told()
                        rows, held = [], 0
        if rows:
            yield told()


class TarDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tar"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> TarReader:
        return TarReader(self.options)


def read_members(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    """(archive, name, size, content) of the members of an archive, or of all archives in a folder."""
    spark.dataSource.register(TarDataSource)
    split = int(options.get("split", SPLIT))
    if "index" not in options and "starts" not in options:
        wanted = endings(options.get("archives", ""))
        large = [a for a, n in archives(path, options.get("suffix", ".tar")) if n > split and a.lower().endswith(wanted)]
        if large:
            options["starts"] = f"{shared_dir(spark)}/starts-{uuid.uuid4().hex}"
            range_starts(spark, large, split).write.parquet(options["starts"])
    reader = spark.read.format("tar").option("path", path)
    for k, v in options.items():
        reader = reader.option(k, str(v).lower() if isinstance(v, bool) else str(v))
    return reader.load()


def range_starts(spark: SparkSession, paths: list[str], split: int) -> DataFrame:
    """(archive, range, first): where the first header of each range of archives begins, by a task for each archive that reads headers once.

    Ranges without a header have no row, but the first one; one that headers before it hold for begins at 0.
    """
    listed = spark.createDataFrame([(a,) for a in paths], "archive string").repartition(len(paths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                first = {0: 0}
                with opened(archive) as file:
                    for m, held in headers(file, tolerant=True):
                        first.setdefault(m.offset // split, 0 if held else m.offset)
                columns = [pa.array([archive] * len(first)), pa.array(list(first), pa.int64()), pa.array(list(first.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["archive", "range", "first"])

    return listed.mapInArrow(run, "archive string, range long, first long")


def tar_index(spark: SparkSession, path: str, suffix: str = ".tar", tolerant: bool = True) -> DataFrame:
    """(archive, name, at, data, size): where members begin, by a task for each archive that reads headers only."""
    found = archives(path, suffix)
    listed = spark.createDataFrame([(a,) for a, _ in found], "archive string").repartition(max(1, len(found)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                with opened(archive) as file:
                    rows: list[Member] = []
                    for m in members(file, tolerant):
                        rows.append(m)
                        if len(rows) == 10_000:
                            yield told(archive, rows)
                            rows = []
                    yield told(archive, rows)

    def told(archive: str, rows: list[Member]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([archive] * len(rows), pa.string()), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], ["archive", "name", "at", "data", "size"])

    return listed.mapInArrow(run, "archive string, name string, at long, data long, size long").sortWithinPartitions("archive", "at")


def stem(name: Column) -> Column:
    """The name without its last extension."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def with_sidecars(found: DataFrame, extensions: tuple[str, ...] = IMAGE_EXTENSIONS, sidecar: str = "json") -> DataFrame:
    """(archive, name, content, sidecar): members with a wanted extension and the text of the member of the same stem with that of sidecars, or null.

    found: (archive, name, content), as of read_members with names = the extensions and the sidecar's.  Of members of one name in an archive, all are rows.
    JSON sidecars are checked: one that is no JSON object fails the job that reads it.
    """
    ends = "|".join(x.lstrip(".") for x in extensions)
    wanted = found.where(F.lower("name").rlike(rf"\.({ends})$")).select("archive", "name", "content", stem(F.col("name")).alias("__stem"))
    texts = found.where(F.endswith("name", F.lit(f".{sidecar}"))).groupBy("archive", stem(F.col("name")).alias("__stem")).agg(F.decode(F.max("content"), "UTF-8").alias("sidecar"))
    if sidecar == "json":
        good = F.from_json("sidecar", "map<string, string>").isNotNull()
        texts = texts.withColumn("sidecar", F.when(good, F.col("sidecar")).otherwise(F.raise_error(F.concat(F.lit("no JSON beside "), "__stem"))))
    return wanted.join(texts, ["archive", "__stem"], "left").select("archive", "name", "content", "sidecar")


def read_tar(spark: SparkSession, path: str, extensions: tuple[str, ...] = IMAGE_EXTENSIONS, sidecar: str = "json", **options: Any) -> DataFrame:
    """(archive, name, content, sidecar) of the archives of a folder, or of one, in byte ranges; rows have no order."""
    return with_sidecars(read_members(spark, path, names=",".join((*extensions, f".{sidecar}")), **options), extensions, sidecar)


def write_tar(rows: DataFrame, folder: str, name: str = "name", content: str = "content") -> DataFrame:
    """Write rows as members of tar archives in a folder, one for each partition, and give (archive, members, bytes).

    A task attempt writes a file of its own name; the archives that count are those in the result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        from pyarrow import fs

        where, inner = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:/") else f"file://{folder}")
        where.create_dir(inner, recursive=True)
        path, n, size = f"{inner}/{uuid.uuid4().hex}.tar", 0, 0
        with where.open_output_stream(path) as out, tarfile.open(fileobj=out, mode="w|") as tar:
            for batch in batches:
                for member, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    info = tarfile.TarInfo(member)
                    info.size = len(data or b"")
                    tar.addfile(info, io.BytesIO(data or b""))
                    n, size = n + 1, size + info.size
        front = folder[: len(folder) - len(inner)] if folder.endswith(inner) else "file://"
        yield pa.RecordBatch.from_arrays([pa.array([front + path]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["archive", "members", "bytes"])

    return rows.select(F.col(name).cast("string"), F.col(content).cast("binary")).mapInArrow(run, "archive string, members long, bytes long")
