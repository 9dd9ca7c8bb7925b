"""Byte-level BPE by monoid tree reduction.

A text is encoded as the two halves' encodings joined; halves are halved until they fit a leaf, which
the tiktoken library encodes.  Two encodings are joined by re-encoding a window around the cut that
grows, on each side, until it ends at a *certain* boundary: a visible character followed by a blank.
No alternative of the splitting pattern matches across such a place and none looks back, so the tokens
outside the window are the same in the part and in the whole, and only the window's tokens are
replaced.  A side without such a place is re-encoded whole.  Joining is associative, with the empty
text as its unit.  Decoding concatenates the leaves' bytes up the same kind of tree.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import decoded, text_bytes

LEAF, WINDOW = 1024, 16


def load_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def certain(text: str, at: int) -> bool:
    return text[at] in " \n\t" and not text[at - 1].isspace()


def edge_before(text: str, start: int, cut: int) -> int:
    """The last certain boundary in (start, cut), or start; looked for in a window that doubles."""
    width, seen = WINDOW, cut
    while seen > start + 1:
        low = max(start + 1, cut - width)
        for at in range(seen - 1, low - 1, -1):
            if certain(text, at):
                return at
        width, seen = 2 * width, low
    return start


def edge_after(text: str, cut: int, end: int) -> int:
    """The first certain boundary in (cut, end), or end."""
    width, seen = WINDOW, cut + 1
    while seen < end:
        high = min(end, cut + width)
        for at in range(seen, high):
            if certain(text, at):
                return at
        width, seen = 2 * width, high
    return end


def join(encode: Callable[[str], list[int]], text: str, start: int, cut: int, end: int, left: list[int], right: list[int]) -> list[int]:
    """The encoding of text[start:end] from those of text[start:cut] and text[cut:end]."""
    if certain(text, cut):
        return left + right
    low, high = edge_before(text, start, cut), edge_after(text, cut, end)
    lost = len(encode(text[low:cut]))
    gone = len(encode(text[cut:high]))
    return left[: len(left) - lost] + encode(text[low:high]) + right[gone:]


def encode_tree(encode: Callable[[str], list[int]], text: str, leaf: int = LEAF) -> list[int]:
    def of(start: int, end: int) -> list[int]:
        if end - start <= leaf:
            return encode(text[start:end])
        cut = (start + end) // 2
        return join(encode, text, start, cut, end, of(start, cut), of(cut, end))

    return of(0, len(text))


def decode_tree(decode: Callable[[list[int]], bytes], ids: list[int], leaf: int = LEAF) -> bytes:
    if len(ids) <= leaf:
        return decode(ids)
    half = len(ids) // 2
    return decode_tree(decode, ids[:half], leaf) + decode_tree(decode, ids[half:], leaf)


def encode_bpe(docs: DataFrame, ranks_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF, decode: bool = False) -> DataFrame:
    """(id, n_tokens, ids[, decoded]): ids are little-endian unsigned 32-bit integers in a binary column.

    Special tokens are never made.  A null or empty text has no tokens; texts of any length are encoded
    whole; rows may repeat, and equal texts get equal ids; other columns are ignored, whatever their
    names; an empty table gives no rows.  The rank file is read once on the driver (its size is that of the vocabulary) and
    broadcast.  Each row is handled alone: no shuffle, and memory is bounded by the longest text.
    """
    with open(ranks_file, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(data.value), special_tokens={})
        for batch in batches:
            counts, packed, back = [], [], []
            for text in decoded(batch.column(1)):
                ids = encode_tree(enc.encode_ordinary, text, leaf)
                counts.append(len(ids))
                packed.append(np.array(ids, "<u4").tobytes())
                if decode:
                    back.append(decode_tree(enc.decode_bytes, ids, leaf))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(packed, pa.binary())]
            names = [id_col, "n_tokens", "ids"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(back, pa.binary())] * decode, names + ["decoded"] * decode)

    src = text_bytes(docs, id_col, text_col)
    kind = src.schema[id_col].dataType.simpleString()
    return src.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids binary" + ", decoded binary" * decode)


def decode_bpe(encoded: DataFrame, ranks_file: str, pattern: str, id_col: str = "doc_id", leaf: int = LEAF) -> DataFrame:
    """(id, decoded) from rows with a binary ``ids`` column as encode_bpe writes it; null ids give no bytes."""
    with open(ranks_file, "rb") as f:
        data = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = {i: w for w, i in load_ranks(data.value).items()}
        for batch in batches:
            out = [decode_tree(lambda ids: b"".join(map(words.__getitem__, ids)), np.frombuffer(x.as_py() or b"", "<u4").tolist(), leaf) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], [id_col, "decoded"])

    src = encoded.select(id_col, "ids")
    return src.mapInArrow(run, f"`{id_col}` {src.schema[id_col].dataType.simpleString()}, decoded binary")
