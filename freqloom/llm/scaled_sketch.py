"""Document fingerprints: threshold-scaled sketches (built-in functions only).

A sketch holds every shingle hash below a fixed fraction of the hash range, so the share of common hashes
estimates containment however unequal two documents are.  Few hashes tell little, so the fractions are
nested: a sketch is of the densest level that keeps at most ``FEW`` hashes, else of the last one, which is
whole however long the text.  Two sketches are compared at the sparser of their two levels, from what they
hold alone; the sketch of a union is exactly that of the merged sketches (see merged), since a union keeps
no fewer hashes of any level.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, whole_text

WORDS, FEW = 5, 64
#: Level 0 holds every hash, level k one of FRACTIONS[k]: those below LIMITS[k] of the signed 64-bit range.
FRACTIONS = (1, 2, 4)
LIMITS = tuple(-(1 << 63) + (1 << 64) // n - (n == 1) for n in FRACTIONS)
LAST = len(FRACTIONS) - 1
#: Rows of a block; blocks, whose first ids go through the driver; and of them in each range that is cut by itself.
BLOCK_ROWS, MAX_BLOCKS, FINE = 500, 100_000, 32
NO_ID = -(1 << 63)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def hashes(text: Column, words: int = WORDS) -> Column:
    """Hashes of the word shingles (of all words, if there are fewer than ``words``), repeats included."""
    found = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")

    def shingles(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - words), lambda i: F.xxhash64(*[w[i + k] for k in range(words)]))
        return F.when(F.size(w) >= words, many).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))

    return let(found, shingles)


def below(h: Column, level: int) -> Column:
    """The distinct hashes of a level, in any order."""
    return F.array_distinct(F.filter(h, lambda x: x < LIMITS[level]) if level else h)


def of_hashes(h: Column, least: Column | int = 0) -> Column:
    """The sketch (level, hashes), hashes ascending, of hashes, which may repeat; it has level ``least`` at least."""

    def made(level: int, held: Column) -> Column:
        return F.struct(F.lit(level).alias("level"), F.array_sort(held).alias("hashes"))

    def from_level(level: int, held: Column) -> Column:
        """The sketch, if no level above this one keeps few; held: the hashes of this level."""
        if not level:
            return made(0, held)
        # Of a long text the last level alone has many: no other is looked at.
        denser = let(below(h, level - 1), lambda d: F.when((F.size(d) > FEW) | (F.lit(level - 1) < least), made(level, held)).otherwise(from_level(level - 1, d)))
        return F.when(F.size(held) > FEW, made(level, held)).otherwise(denser)

    return let(below(h, LAST), lambda d: from_level(LAST, d))


def sketch(text: Column, words: int = WORDS) -> Column:
    """(level, hashes) of the word shingles' hashes."""
    return let(hashes(text, words), of_hashes)


def merged(a: Column, b: Column) -> Column:
    """The sketch of the union of what two sketches were made of, exactly."""
    return let(F.struct(F.concat(a["hashes"], b["hashes"]).alias("h"), F.greatest(a["level"], b["level"]).alias("least")), lambda x: of_hashes(x["h"], x["least"]))


def at_level(a: Column, level: Column) -> Column:
    """The sketch's hashes that a sketch of so sparse a level would hold."""
    return F.when(a["level"] >= level, a["hashes"]).otherwise(let(F.element_at(F.lit(list(LIMITS)), level + 1), lambda limit: F.filter(a["hashes"], lambda h: h < limit)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the smaller text's shingles that the other has, 0 to 1; equal sketches: 1; without a hash of both at the common level: 0."""

    def share(both: Column) -> Column:
        x, y = both["x"], both["y"]
        few = F.least(F.size(x), F.size(y))
        return F.when(few > 0, F.size(F.array_intersect(x, y)) / few).otherwise(0.0)

    level = F.greatest(a["level"], b["level"])
    return F.when(a == b, F.lit(1.0)).otherwise(let(F.struct(at_level(a, level).alias("x"), at_level(b, level).alias("y")), share))


def as_string(a: Column) -> Column:
    """The level's digit and the hashes in hexadecimal."""
    return F.concat(a["level"].cast("string"), F.array_join(F.transform(a["hashes"], lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), ""))


def of_string(text: Column) -> Column:
    """The sketch of a fingerprint string."""
    n = ((F.length(text) - 1) / 16).cast("int")
    part = F.transform(F.sequence(F.lit(1), n), lambda k: F.conv(F.substring(text, k * 16 - 14, F.lit(16)), 16, -10).cast("bigint"))
    return F.struct(F.substring(text, 1, 1).cast("int").alias("level"), F.when(n > 0, part).otherwise(F.array().cast("array<bigint>")).alias("hashes"))


def bounds_of(ids: DataFrame, blocks: int, fine: int = FINE) -> list[int]:
    """Ascending values of column id that cut its rows into about ``blocks`` like blocks.

    Rows are dealt by range; each range is cut at quantiles by itself, so only the bounds meet.
    """
    if blocks < 2:
        return []
    dealt = ids.repartitionByRange(-(-blocks // fine), "id").select("id", F.spark_partition_id().alias("part"))
    cuts = dealt.groupBy("part").agg(F.percentile_approx("id", [k / fine for k in range(fine)], 50 * fine).alias("cuts"))
    return sorted({x for r in cuts.collect() for x in r["cuts"]})


def block_of(bounds: list[int], value: Column) -> Column:
    """How many of the ascending bounds are at most value, by binary search."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(F.lit(steps), F.lit(0), lambda lo, s: F.when((lo + s <= len(bounds)) & (F.get(constant(bounds), lo + s - 1) <= value), lo + s).otherwise(lo))


def constant(values: list[int]) -> Column:
    """The values as one constant, which is folded when the query is planned."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def with_next(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, text, sketch, next_text, next_sketch) of rows (id, text): next in ascending order of ids (after the last: the first).

    Rows are cut into blocks of ids, so each block begins at a known id; only the first rows of blocks
    are looked up across blocks.  One shuffle of the texts, no global sort, no single task.  A block is
    sorted and read in a stream; beyond MAX_BLOCKS blocks it grows instead of their number.
    """
    key = F.coalesce(F.col("id").cast("long"), F.lit(NO_ID))
    n, least = rows.agg(F.count(F.lit(1)), F.min(key)).first()
    bounds = [x for x in bounds_of(rows.select(key.alias("id")), min(MAX_BLOCKS, n // block_rows)) if x > least] if n else []
    rows = rows.select("id", "text", key.alias("key"), block_of(bounds, key).alias("block"))
    starts = (F.col("key") == least) | (F.get(constant(bounds), F.col("block") - 1) == F.col("key")) if bounds else F.col("key") == F.lit(least)
    firsts = rows.where(starts).groupBy("block").agg(F.min(F.struct("key", "text"))["text"].alias("first"))
    firsts = firsts.select(F.pmod(F.col("block") - 1, F.lit(len(bounds) + 1)).alias("block"), "first", sketch(F.col("first")).alias("first_sketch"))
    # Sketches are made where the texts have been dealt, so that they aren't moved themselves.
    dealt = rows.repartition("block").withColumn("sketch", sketch(F.col("text")))
    w = Window.partitionBy("block").orderBy("key", "text")
    led = dealt.select("id", "text", "sketch", "block", F.lead(F.struct("text", "sketch")).over(w).alias("next"))
    both = led.join(firsts, "block", "left")
    at_end = F.col("next").isNull()
    return both.select("id", "text", "sketch", F.when(at_end, F.col("first")).otherwise(F.col("next.text")).alias("next_text"), F.when(at_end, F.col("first_sketch")).otherwise(F.col("next.sketch")).alias("next_sketch"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, n_chars, edited, sketch, next_sketch, near_next, edited_sketch, near_edited) for each row.

    edited is the text with its last quarter of code points replaced by the first as many of the next
    document (by ascending id; rows with one id follow each other by text; a null id comes first).  near_next
    and near_edited are made of the sketches alone.  Null texts are empty; texts of any length are taken
    whole; repeated rows are each other's next; a lone document is its own next; other columns are ignored,
    whatever their names; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    wide = with_next(docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text")), block_rows)
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    wide = wide.select("id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch", containment(F.col("sketch"), F.col("next_sketch")).alias("near_next"))
    wide = wide.withColumn("edited_sketch", sketch(F.col("edited")))
    near = containment(F.col("sketch"), F.col("edited_sketch"))
    return wide.select(F.col("id").alias(id_col), "n_chars", "edited", "sketch", "next_sketch", "near_next", "edited_sketch", near.alias("near_edited"))
