"""Contiguous shards of near-equal bytes from global prefix sums, in DataFrame functions only.

Rows are put in id order over range partitions. Each partition sums its own sizes; the totals, one row a partition, are
summed once more, which gives every row its place among all bytes. Shard k takes the rows that begin in the k-th of
``shards`` equal parts of all bytes, so shards differ by less than one row's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, partitions


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, size (UTF-8 bytes and 1; null text: 1), text_crc32, shard, slot (gapless in the shard), byte_start.

    Rows are ordered by id, nulls first; rows with one id by their place in the input. Only ids, sizes and checksums
    are shuffled, never texts. A partition of rows with one id is split by that place, so a frequent id is no hot spot.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("uid"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"))
    sized = scratch.write(sized, "sized")
    # the partition a row lands in is written down: later jobs must see the same cut
    blocks = scratch.write(sized.repartitionByRange(partitions(spark), "id", "uid").withColumn("block", F.spark_partition_id()), "blocks")
    scratch.drop("sized")

    totals = blocks.groupBy("block").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select("block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"), F.sum("bytes").over(everything).alias("all_bytes"))

    inside = Window.partitionBy("block").orderBy(F.col("id").asc_nulls_first(), "uid")
    placed = blocks.select("*", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"), F.row_number().over(inside).alias("r"))
    placed = placed.join(F.broadcast(totals), "block").select("id", "size", "text_crc32", (F.col("bytes_before") + F.col("b")).alias("byte_start"), (F.col("rows_before") + F.col("r") - 1).alias("rank"), "all_bytes")
    shard = F.least(F.lit(shards - 1), F.floor(F.col("byte_start").cast("decimal(38,0)") * shards / F.col("all_bytes"))).cast("int")
    placed = placed.withColumn("shard", shard)
    first = placed.groupBy("shard").agg(F.min("rank").alias("first_rank"))  # one row a shard
    return placed.join(F.broadcast(first), "shard").select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("rank") - F.col("first_rank")).cast("long").alias("slot"), "byte_start")
