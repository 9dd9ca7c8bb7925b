"""Optimal length buckets and token-budget batches of token sequences.

Documents longer than ``max_len`` are cut into segments of that length (none is dropped), so the global
histogram of segment lengths has at most max_len + 1 rows.  Dynamic programming over it chooses the
bucket lengths with the least padding in all.  Batches of at most ``budget`` padded tokens then form
inside each bucket: in shards of about ``SHARD`` segments, dealt by hash, so no bucket ever meets in
one task; the last batch of a shard may be smaller.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .records import encode_words

MAX_LEN, BUCKETS, BUDGET, SHARD = 2048, 12, 65536, 16384


def optimal_buckets(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """At most ``buckets`` bucket lengths, ascending, that minimise the sum of count * (bucket - length).

    The last bucket is the largest length; of equally good choices the one with smaller cuts is taken.
    """
    if not lengths:
        return []
    order = np.argsort(lengths)
    x, n = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    rows, total = np.concatenate(([0], np.cumsum(n))), np.concatenate(([0], np.cumsum(n * x)))
    m = len(x)
    # best[j]: least padding of the first j lengths in k buckets; cut[k][j]: where the last of them begins
    best = np.concatenate(([0], x * rows[1:] - total[1:]))
    cuts = [np.zeros(m + 1, np.int64)]
    for _ in range(1, min(buckets, m)):
        now, where = best.copy(), np.zeros(m + 1, np.int64)
        for j in range(1, m + 1):
            pad = best[:j] + x[j - 1] * (rows[j] - rows[:j]) - (total[j] - total[:j])
            where[j] = i = int(np.argmin(pad))
            now[j] = pad[i]
        best = now
        cuts.append(where)
    chosen, j = [], m
    for where in reversed(cuts):
        if not j:
            break
        chosen.append(int(x[j - 1]))
        j = int(where[j])
    return chosen[::-1]


def segments(rows: DataFrame, id_col: str, length_col: str, max_len: int) -> DataFrame:
    """(id, segment, length[, width, ids]): rows cut at max_len; a length of zero is one segment of length zero."""
    n = F.coalesce(F.col(length_col).cast("long"), F.lit(0))
    last = F.greatest(F.ceil(n / max_len) - 1, F.lit(0)).cast("int")
    held = ["width", "ids"] if "ids" in rows.columns else []
    cutted = rows.select(F.col(id_col).alias("id"), n.alias("n"), *held, F.explode(F.sequence(F.lit(0), last)).alias("segment"))
    length = F.least(F.lit(max_len), F.col("n") - F.col("segment").cast("long") * max_len)
    part = [F.col("width"), F.substring("ids", (F.col("segment") * max_len * F.col("width") + 1).cast("int"), (length * F.col("width")).cast("int")).alias("ids")] if held else []
    return cutted.select("id", "segment", length.alias("length"), *part)


def pack(rows: DataFrame, id_col: str = "doc_id", length_col: str = "n_tokens", max_len: int = MAX_LEN, buckets: int = BUCKETS, budget: int = BUDGET, shard_rows: int = SHARD) -> DataFrame:
    """(id, segment, n_tokens, bucket, shard, batch, batch_rows[, width, ids]): where each segment of each row goes.

    rows: id and length, and if there are columns width and ids (encode_words makes them), the segments
    carry their own ids; other columns are ignored.  bucket is the padded length; (bucket, shard,
    batch) names a batch, which has at most max(1, budget // bucket) segments.  Within a shard, segments
    go by id, number and ids.  Null lengths are zero; rows may repeat (each is packed; equal ones lie
    together); an empty table gives no rows.
    """
    held = ["width", "ids"] if {"width", "ids"} <= set(rows.columns) else []
    rows = cut(rows.select(id_col, length_col, *held))
    pieces = segments(rows, id_col, length_col, max_len)
    histogram = segments(rows.select(id_col, length_col), id_col, length_col, max_len).groupBy("length").count().collect()  # max_len + 1 rows at most
    bounds = optimal_buckets([r[0] for r in histogram], [r[1] for r in histogram], buckets)
    shards = max(1, round(sum(r[1] for r in histogram) / shard_rows))
    bucket = F.lit(bounds[-1] if bounds else 0).cast("long")
    for b in reversed(bounds[:-1]):
        bucket = F.when(F.col("length") <= b, F.lit(b).cast("long")).otherwise(bucket)
    key = ["id", "segment", *held[1:]]
    dealt = pieces.select("id", "segment", F.col("length").alias("n_tokens"), *held, bucket.alias("bucket"), F.pmod(F.xxhash64(*key), F.lit(shards)).cast("int").alias("shard"))
    nth = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy(*key)) - 1
    fits = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("bucket", F.lit(1)))).cast("long")
    out = dealt.withColumn("batch", F.floor(nth / fits).cast("long"))
    size = F.count(F.lit(1)).over(Window.partitionBy("bucket", "shard", "batch"))
    return out.select(F.col("id").alias(id_col), "segment", "n_tokens", "bucket", "shard", "batch", size.alias("batch_rows"), *held)


def pack_documents(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 1, **options: int) -> DataFrame:
    """pack() of the token ids of docs, by the tokenizers library, with end_id at the end; see there and encode_words.

    ids are little-endian unsigned integers of ``width`` bytes.  A null or empty text is its end id.
    """
    return pack(encode_words(docs.select(id_col, text_col), tokenizer_file, id_col, text_col, end_id), id_col, "n_tokens", **options)
