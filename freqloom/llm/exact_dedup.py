"""Exact de-duplication with a heavy-hitter split (built-in functions only).

Each text becomes one digest row, written once to shared storage.  A frequent-items sketch of the
Misra-Gries family finds every digest that holds more than ``1 / slots`` of the rows; those few are
counted exactly (with map-side combining) and broadcast, so their rows never meet in one task.  What
remains has at most ``rows / slots`` copies per digest: its digests are counted by ordinary shuffling,
with map-side combining too, and joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, small_batches, whole_text

#: Broadcast bound: at most this many digests (about 100 bytes each) are treated as frequent.
SLOTS = 1024
#: Counters of the sketch; its error is under 4 / TRACKED of the rows, far below 1 / SLOTS.
TRACKED = 65536


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, text_sha256, row): row numbers rows, to break ties between equal ids."""
    return docs.select(F.col(id_col), F.sha2(ascii_lower(whole_text(text_col)), 256).alias("text_sha256"), F.monotonically_increasing_id().alias("__row"))


def frequent(rows: DataFrame, slots: int = SLOTS, tracked: int = TRACKED) -> DataFrame:
    """Exact (text_sha256, group_size, best) of the digests with over rows / slots copies; at most slots rows."""
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(text_sha256, {slots}, {tracked})").alias("top"))
    candidates = found.select(F.col("n"), F.explode("top.item").alias("text_sha256"))
    return (
        rows.join(F.broadcast(candidates), "text_sha256")
        .groupBy("text_sha256", "n")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max("__key").alias("best"))
        .where((F.col("group_size") > 1) & (F.col("group_size") * slots > F.col("n")))
        .drop("n")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, tracked: int = TRACKED) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for each input row.

    Texts are equal when identical after lower-casing A-Z; a null text is an empty one.  The row with
    the largest id stays (a null id is the smallest; of rows with equal ids and texts exactly one
    stays).  Texts of any length are compared whole, by SHA-256.  Other columns of ``docs`` are ignored, whatever their names; an empty input gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = cut(digests(docs, id_col, text_col)).select(id_col, "text_sha256", F.struct(F.col(id_col).alias("id"), F.col("__row").alias("row")).alias("__key"))
    heavy = cut(frequent(rows, slots, tracked))
    out = (id_col, F.col("best.id").alias("keep_id"), "group_size", (F.col("__key") == F.col("best")).alias("kept"), "text_sha256")
    removed_early = rows.join(F.broadcast(heavy), "text_sha256").select(*out)
    rest = rows.join(F.broadcast(heavy.select("text_sha256")), "text_sha256", "left_anti")
    winners = rest.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"), F.max("__key").alias("best"))
    return removed_early.unionByName(rest.join(winners, "text_sha256").select(*out))
