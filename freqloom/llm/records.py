"""Token sequences as length-delimited binary records, with a separate offset index.

A file is a run of frames: payload length (8 bytes, little-endian), masked CRC-32 of those 8 bytes,
payload, masked CRC-32 of the payload.  The mask rotates the checksum right by 15 bits and adds a
constant, so that checksums of data that hold checksums stay sound.  Ids are little-endian unsigned
integers of 2 bytes (vocabularies up to 65,536) or 4.  The index, a Parquet table beside the files,
has file, offset, n_tokens and place of every record, so readers can take records in any order.

Files go through pyarrow's file systems to the shared folder.  Each attempt of a task writes a file of
its own name and only the index names the files that count: a lost executor leaves orphans, never a
half-written or doubled record.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import once_per_worker, small_batches, text_bytes

#: Fixed values of the file format.
MASK = 0xA282EAD8
HEAD, FOOT = 12, 4
#: Bytes of neighbouring records that are read at once.
SPAN = 4 << 20
LEAST_ROWS, MOST_ROWS = 1000, 50_000
#: Pre-tokens kept with their ids in a worker; beyond it the memo starts anew.
MEMO = 200_000


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked_crc(length)), payload, struct.pack("<I", masked_crc(payload))))


def unframe(data: bytes) -> bytes:
    """The payload of one frame; raises ValueError if a checksum or the length does not fit."""
    if len(data) < HEAD + FOOT or struct.unpack("<I", data[8:HEAD])[0] != masked_crc(data[:8]):
        raise ValueError("record: bad length checksum")
    (n,) = struct.unpack("<Q", data[:8])
    payload = data[HEAD : HEAD + n]
    if len(data) != HEAD + n + FOOT or struct.unpack("<I", data[HEAD + n :])[0] != masked_crc(payload):
        raise ValueError("record: bad data checksum")
    return payload


#: What a tokenizer file must say for words to be encoded one by one.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: Words of these characters only are their own NFC form and have one lower-case letter for each letter.
PLAIN = re.compile("[!-~\u00c0-\u012f\u0131-\u017f]*")
#: Fixed value: how the tokenizer splits lower-case words of such characters before its merges.
PRETOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: Bytes of text that are encoded at once: the more, the smaller the share of distinct words.
TOGETHER = 8 << 20

#: Byte-level alphabet: visible Latin-1 bytes stand for themselves, the others for U+0100 onwards in order.
VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_LETTERS = {b: 0x100 + k for k, b in enumerate(x for x in range(0x100) if x not in VISIBLE)}


def as_strings(texts: pa.Array) -> pa.Array:
    try:
        return texts.cast(pa.string())
    except pa.ArrowInvalid:  # not UTF-8
        return pa.array([x.as_py().decode("utf-8", "replace") for x in texts], pa.string())


def by_words(said: dict) -> bool:
    """Whether a tokenizer file's ids of a text are those of its words: known normaliser and splitter, plain BPE, nothing added."""
    model = said["model"]
    split = {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]}
    plain = model["type"] == "BPE" and not model.get("dropout") and not any(said.get(k) for k in ("truncation", "padding", "post_processor"))
    return plain and said["normalizer"] == NORMALIZER and said["pre_tokenizer"] == split and not any(x["normalized"] or x["lstrip"] or x["rstrip"] for x in said["added_tokens"])


class TokenIds(dict):
    """Ids of pre-tokens as bytes, found by the tokenizers library once and kept in two generations of MEMO.

    A text with the string of an added token, and any text of a tokenizer that does not go by words, is
    encoded whole by the library.
    """

    def __init__(self, tok: Any) -> None:
        super().__init__()
        said = json.loads(tok.to_str())
        self.tok, self.model, self.old = tok, tok.model, {}
        self.by_words, self.added = by_words(said), [x["content"] for x in said["added_tokens"]]
        self.width = 2 if tok.get_vocab_size() <= 1 << 16 else 4
        self.form = {2: "H", 4: "I"}[self.width]

    def pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.form}", *ids)

    def __missing__(self, pretoken: str) -> bytes:
        """A plain lower-case pre-token needs the library's merges only."""
        found = self.old.get(pretoken)
        if found is None:
            letters = pretoken if pretoken.isascii() else pretoken.encode().decode("latin-1").translate(BYTE_LETTERS)
            found = self.pack([x.id for x in self.model.tokenize(letters)])
        if len(pretoken) <= 64:
            self[pretoken] = found
        return found

    def word(self, word: str) -> bytes:
        if PLAIN.fullmatch(word):
            return b"".join(map(self.__getitem__, PRETOKENS.findall(word.lower())))
        return self.pack(self.tok.encode(word, add_special_tokens=False).ids)

    def encode_texts(self, texts: pa.Array) -> list[bytes]:
        """Each text's packed ids: the batch's distinct words are encoded once, the rest is a gather."""
        texts = as_strings(texts)
        whole = np.full(len(texts), not self.by_words)
        for added in self.added:
            whole |= pc.match_substring(texts, added).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self.encode_words(texts)
        out: list[bytes] = [b""] * len(texts)
        for mask, ids in ((whole, lambda part: [self.pack(x.ids) for x in self.tok.encode_batch(part.to_pylist(), add_special_tokens=False)]), (~whole, self.encode_words)):
            for k, x in zip(np.flatnonzero(mask).tolist(), ids(texts.filter(pa.array(mask)))):
                out[k] = x
        return out

    def encode_words(self, texts: pa.Array) -> list[bytes]:
        split = pc.ascii_split_whitespace(texts)
        ends = np.concatenate(([0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False)))).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        known = [self.word(x) for x in coded.dictionary.to_pylist()]
        if len(self) > MEMO:
            self.old = dict(self)
            self.clear()
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // self.width
        starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        at = coded.indices.to_numpy()
        each = sizes[at]
        upto = np.concatenate(([0], np.cumsum(each)))
        ids = np.frombuffer(b"".join(known), f"<u{self.width}")[np.repeat(starts[at] - upto[:-1], each) + np.arange(upto[-1])]
        cuts = upto[ends].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]


Batches = Iterator[pa.RecordBatch]


def together(batches: Batches, size: int) -> Batches:
    """The same rows in batches of about ``size`` bytes at least."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.nbytes for x in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def encoder(spark: SparkSession, tokenizer_file: str, end_id: int | None) -> Callable[[Batches], Batches]:
    """From batches (id, text) to (id, n_tokens, width, ids); the file goes to the workers by broadcast (its size is the vocabulary's)."""
    with open(tokenizer_file, "rb") as f:
        content = f.read()
    name, data = zlib.crc32(content), spark.sparkContext.broadcast(content)

    def run(batches: Batches) -> Batches:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        memo = once_per_worker(f"tokens_{name}", lambda: TokenIds(Tokenizer.from_buffer(data.value)))
        width, tail = memo.width, b"" if end_id is None else end_id.to_bytes(memo.width, "little")
        for batch in together(batches, TOGETHER):
            packed = [x + tail for x in memo.encode_texts(batch.column(1))]
            lengths = pa.array([len(x) // width for x in packed], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), lengths, pa.array([width] * len(packed), pa.int32()), pa.array(packed, pa.binary())], ["id", "n_tokens", "width", "ids"])

    return run


def writer(folder: str) -> Callable[[Batches], Batches]:
    """Writes batches (id, n_tokens, width, ids) to a file of the partition; gives (id, part, file, offset, n_tokens, width, within)."""

    def run(batches: Batches) -> Batches:
        part = TaskContext.get().partitionId()
        store, path = pafs.FileSystem.from_uri(folder)
        name, offset, before, out = f"part-{part:05d}-{uuid.uuid4().hex}.rec", 0, 0, None
        for batch in batches:
            offsets, places = [], []
            for n, ids in zip(batch.column(1).to_pylist(), batch.column(3)):
                if out is None:
                    out = store.open_output_stream(f"{path}/{name}", buffer_size=1 << 20)
                data = frame(ids.as_py())
                out.write(data)
                offsets.append(offset)
                places.append(before)
                offset, before = offset + len(data), before + n
            k = len(offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([part] * k, pa.int32()), pa.array([name] * k, pa.string()), pa.array(offsets, pa.int64()), batch.column(1), batch.column(2), pa.array(places, pa.int64())],
                ["id", "part", "file", "offset", "n_tokens", "width", "within"],
            )
        if out is not None:
            out.close()

    return run


def kind(df: DataFrame, column: str) -> str:
    return f"id {df.schema[column].dataType.simpleString()}"


def encode_words(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = None) -> DataFrame:
    """(id, n_tokens, width, ids): the tokenizers library's ids without special tokens, end_id appended.

    Any tokenizer file will do; strings of its added tokens become those tokens, as the library has it.
    Of a tokenizer that goes by words (see by_words), a word of plain characters has the ids of its
    pre-tokens, which workers keep once found.  A null text is empty; rows may repeat; other columns are
    ignored; an empty table gives no rows.
    """
    src = text_bytes(docs, id_col, text_col)
    return src.mapInArrow(encoder(docs.sparkSession, tokenizer_file, end_id), f"{kind(src, id_col)}, n_tokens long, width int, ids binary").withColumnRenamed("id", id_col)


def indexed(written: DataFrame, folder: str, id_col: str) -> DataFrame:
    """Run the writing job, which saves the index, and return the index with each record's place."""
    spark = written.sparkSession
    store, path = pafs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    written.write.parquet(f"{folder}/index")
    index = spark.read.parquet(f"{folder}/index")
    # One row per file: few, and the only rows that meet in one task.
    files = index.groupBy("part", "file").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    return index.join(F.broadcast(files), "file").select(F.col("id").alias(id_col), "file", "offset", "n_tokens", "width", (F.col("base") + F.col("within")).alias("place"))


INDEX = "part int, file string, offset long, n_tokens long, width int, within long"


def write_records(rows: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """Write the ids of rows (id, n_tokens, width, ids), which lie in order, and return their index.

    Partitions become files in their order, so range-partitioned sorted rows stay sorted over all
    files.  The index is (id, file, offset, n_tokens, width, place): place counts the ids of all
    records before.
    """
    small_batches(rows.sparkSession)
    return indexed(rows.select(id_col, "n_tokens", "width", "ids").mapInArrow(writer(folder), f"{kind(rows, id_col)}, {INDEX}"), folder, id_col)


def frames(store: pafs.FileSystem, path: str, places: list[tuple[str, int, int]]) -> Iterator[bytes]:
    """The frames at the places (file, offset, size), in their order; neighbours are read together, up to SPAN bytes."""
    name, source = None, None
    try:
        at = 0
        while at < len(places):
            file, first, size = places[at]
            end, upto = first + size, at + 1
            while upto < len(places) and places[upto][:2] == (file, end) and end + places[upto][2] - first <= SPAN:
                end, upto = end + places[upto][2], upto + 1
            if file != name:
                if source is not None:
                    source.close()
                name, source = file, store.open_input_file(f"{path}/{file}")
            span = source.read_at(end - first, first)
            for _, offset, size in places[at:upto]:
                yield span[offset - first : offset - first + size]
            at = upto
    finally:
        if source is not None:
            source.close()


def read_records(index: DataFrame, folder: str, id_col: str = "doc_id", ids: bool = True) -> DataFrame:
    """(id, place, n_tokens, width, ids, ids_crc32) read back from the files, each checksum verified.

    Any subset or order of the index will do.  ids_crc32 is that of the ids as little-endian unsigned
    32-bit integers; without ``ids`` the ids themselves are left null.
    """

    def run(batches: Batches) -> Batches:
        store, path = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            out, sums = [], []
            files, offsets, counts, widths = (batch.column(k).to_pylist() for k in range(1, 5))
            places = [(file, offset, HEAD + n * width + FOOT) for file, offset, n, width in zip(files, offsets, counts, widths)]
            for width, data in zip(widths, frames(store, path, places)):
                payload = unframe(data)
                sums.append(zlib.crc32(payload if width == 4 else np.frombuffer(payload, f"<u{width}").astype("<u4")))
                out.append(payload if ids else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(5), batch.column(3), batch.column(4), pa.array(out, pa.binary()), pa.array(sums, pa.int64())], ["id", "place", "n_tokens", "width", "ids", "ids_crc32"])

    small_batches(index.sparkSession)
    rows = index.select(id_col, "file", "offset", "n_tokens", "width", "place")
    return rows.mapInArrow(run, f"{kind(index, id_col)}, place long, n_tokens long, width int, ids binary, ids_crc32 long").withColumnRenamed("id", id_col)


def file_count(rows: int, cores: int) -> int:
    """Two files for each core, as long as each gets LEAST_ROWS, and no file of over MOST_ROWS."""
    return max(1, min(2 * cores, rows // LEAST_ROWS), -(-rows // MOST_ROWS))


def encode_to_records(docs: DataFrame, tokenizer_file: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 1) -> DataFrame:
    """Encode docs, write them in ascending id order (nulls first, equal ids by a hash of the text); return the index.

    Encoding and writing share one Python worker; the texts are shuffled once, by range of ids, and of
    equal ids by range of text hashes.  A null text is an empty one, whose record holds the end id only;
    rows may repeat, each has its record; a text of any length is one record; other columns are ignored;
    an empty table gives no records and no files.
    """
    spark: SparkSession = docs.sparkSession
    order = (F.col(id_col), F.xxhash64(text_col))
    parts = file_count(docs.count(), spark.sparkContext.defaultParallelism)
    dealt = text_bytes(docs, id_col, text_col).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    encode, write = encoder(spark, tokenizer_file, end_id), writer(folder)
    return indexed(dealt.mapInArrow(lambda batches: write(encode(batches)), f"{kind(docs, id_col)}, {INDEX}"), folder, id_col)
