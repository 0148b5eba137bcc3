"""Exact duplicates by two passes over a Bloom filter, in DataFrame functions only.

Pass one adds two bit positions of each text's hash to a filter and keeps the bits that were set more than once. Pass two
tests every row against that filter: a row with a bit that was set once has no equal and passes straight through. Only
the rest (the repeated ones, and about one in a hundred others) are shuffled, by the SHA-256 of the normalised text.

The filter has 16 to 32 bits a row, and 2**30 bits (128 MB) at most, which bounds the broadcast. Beyond that bound more
rows are shuffled; the result stays exact, as the filter never decides by itself that two texts are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lower_ascii

#: Bits in one bitmap of Spark's bitmap functions.
BITMAP_BITS = 32768
MAX_FILTER_BITS = 1 << 30
#: Groups of more than one row in so many are told to all tasks: there are fewer of them than this.
HOT = 1024


def _positions(h: Column, bits: int) -> list[Column]:
    return [F.pmod(h, F.lit(bits)), F.pmod(F.xxhash64(h, F.lit(17)), F.lit(bits))]


def filter_bits(rows: int, max_bits: int = MAX_FILTER_BITS) -> int:
    """A power of two with 16 bits a row at least, within bounds."""
    return min(max_bits, max(BITMAP_BITS, 1 << (16 * max(rows, 1) - 1).bit_length()))


def filter_of(hashes: DataFrame, bits: int, least: int = 2) -> DataFrame:
    """(bucket, bitmap): the filter's bits that ``least`` probes or more have set. At most ``bits`` / 8 bytes in all."""
    probes = hashes.select(F.explode(F.array(*_positions(F.col("h"), bits))).alias("pos"))
    twice = probes.groupBy("pos").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return twice.groupBy(F.floor(F.col("pos") / BITMAP_BITS).alias("bucket")).agg(F.bitmap_construct_agg(F.col("pos") % BITMAP_BITS).alias("bitmap"))


def mark(rows: DataFrame, bitmaps: DataFrame, bits: int) -> DataFrame:
    """Adds ``maybe``: false only if a bit of ``h`` is not in the filter."""
    out = rows
    for i, pos in enumerate(_positions(F.col("h"), bits)):
        side = F.broadcast(bitmaps.select(F.col("bucket").alias(f"_b{i}"), F.col("bitmap").alias(f"_m{i}")))
        out = out.withColumn(f"_p{i}", pos).join(side, F.floor(F.col(f"_p{i}") / BITMAP_BITS) == F.col(f"_b{i}"), "left")
        bit = F.col(f"_p{i}") % BITMAP_BITS
        byte = F.conv(F.hex(F.substring(F.col(f"_m{i}"), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        out = out.withColumn(f"_t{i}", F.coalesce(F.shiftright(byte, 0).bitwiseAND(F.expr(f"shiftleft(1, cast(_p{i} % 8 as int))")) != 0, F.lit(False)))
    return out.withColumn("maybe", F.col("_t0") & F.col("_t1")).drop(*[f"_{k}{i}" for k in "bmpt" for i in range(2)])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after lower-casing A-Z; a null text counts as empty. Of equal texts the row with the
    largest id stays (a null id counts as smallest; of rows repeated with one id, one stays). An empty table gives none.
    """
    scratch = Scratch(docs.sparkSession, "exact_dedup")
    norm = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    sha = F.unhex(F.sha2(F.encode(norm, "utf-8"), 256))
    hashes = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("uid"), sha.alias("sha"))
    hashes = scratch.write(hashes, "hashes").withColumn("h", F.xxhash64("sha"))
    rows = hashes.count()
    bits = filter_bits(rows, max_bits)
    marked = mark(hashes, scratch.write(filter_of(hashes, bits), "filter"), bits).drop("h")
    alone = marked.where(~F.col("maybe")).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    again = marked.where("maybe").drop("maybe")
    groups = again.groupBy("sha").agg(F.max(F.struct("id", "uid")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    groups = scratch.write(groups, "groups")
    hot = F.broadcast(groups.where(F.col("group_size") * HOT > rows))
    rest = again.join(hot.select("sha"), "sha", "left_anti").join(groups.where(F.col("group_size") * HOT <= rows), "sha")
    again = again.join(hot, "sha").unionByName(rest).select("id", F.col("keep.id").alias("keep_id"), "group_size", (F.col("uid") == F.col("keep.uid")).alias("kept"), "sha")
    return alone.unionByName(again).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    The row to keep is found first, by hash and id, without texts. A second filter holds those that are kept, so of the
    rows that may be repeated only they, and about one in a hundred others, are shuffled with their texts. Nulls, ties,
    repeated rows and empty tables are as in :func:`exact_dedup`.
    """
    scratch = Scratch(docs.sparkSession, "exact_dedup")
    norm = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    cols = docs.columns
    key = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), F.col(id_col).alias("id"), F.unhex(F.sha2(F.encode(norm, "utf-8"), 256)).alias("sha"))
    hashes = scratch.write(key.select("id", "sha"), "hashes").withColumn("h", F.xxhash64("sha"))
    bits = filter_bits(hashes.count(), max_bits)
    bitmaps = scratch.write(filter_of(hashes, bits), "filter")
    keep = mark(hashes, bitmaps, bits).where("maybe").groupBy("sha").agg(F.max("id").alias("keep_id"))
    keep = scratch.write(keep, "keep")
    own_bits = filter_bits(keep.count(), max_bits)
    own = scratch.write(filter_of(keep.select(F.xxhash64("sha", "keep_id").alias("h")), own_bits, 1), "kept")
    marked = mark(key.withColumn("h", F.xxhash64("sha")), bitmaps, bits)
    again = mark(marked.where("maybe").withColumn("h", F.xxhash64("sha", "id")), own, own_bits)
    again = again.where("maybe").join(keep.withColumnRenamed("sha", "k_sha"), (F.col("sha") == F.col("k_sha")) & F.col("id").eqNullSafe(F.col("keep_id")))
    again = again.groupBy("sha", "id").agg(F.first("row").alias("row"))
    return marked.where(~F.col("maybe")).select("row").unionByName(again.select("row")).select("row.*")
