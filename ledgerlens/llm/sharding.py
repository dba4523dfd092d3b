"""Contiguous shards of near-equal bytes [native].

Rows are range-partitioned by the order key, so each partition holds one
stretch of the global order. Byte totals per partition (and per block of a few
thousand rows within it) are prefix-summed into the byte position of every
row; the positions are cut at equal targets. Only digests (key, size,
checksum) take part unless the caller asks for more columns to be carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import materialise, shuffle_partitions

OVERHEAD = 8  # bytes counted for a row besides its text
ROWS_PER_RANGE = 2_000_000
ROWS_PER_BLOCK = 4096


def assign_shards(docs: DataFrame, n_shards: int = 24, key: str = "doc_id", text: str = "text",
                  carry: list[str] | tuple = ()) -> DataFrame:
    """(key, size, text_crc32, shard, slot[, carried struct]) of every row.

    size: UTF-8 bytes of the text plus 8 (a null text has none); shard: the
    target in which the middle of the row's byte range falls, so shards are
    contiguous in the order and their sizes differ by less than the largest
    row; slot: the row's place in its shard, gapless from 0.

    Order: key (nulls first), then checksum, then the position in the input,
    which spreads a hot key or a group of identical rows over many ranges
    (identical rows are interchangeable). Empty tables give no rows. Other
    columns of ``docs`` are ignored unless named in ``carry``; they travel in
    one struct, so their names cannot clash with the results.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("k"), (F.octet_length(body).cast("long") + OVERHEAD).alias("size"),
                       F.crc32(body).alias("crc"), F.monotonically_increasing_id().alias("seen"),
                       F.struct(*[F.col(c) for c in carry]).alias("carried") if carry else F.lit(0).alias("carried"))
    n = max(shuffle_partitions(spark), -(-docs.count() // ROWS_PER_RANGE))
    order = ["k", "crc", "seen"]
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = (rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
              .select("k", "size", "crc", "carried", F.spark_partition_id().alias("part"), local.alias("idx"))
              .withColumn("block", F.expr(f"idx div {ROWS_PER_BLOCK}")))
    ranged = materialise(ranged)

    # byte and row totals per block and per partition, prefix-summed
    blocks = ranged.groupBy("part", "block").agg(F.sum("size").alias("bytes"))
    before = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("in_part", F.coalesce(F.sum("bytes").over(before), F.lit(0)))
    # one row per partition: a window without keys over a few thousand rows at most
    parts = ranged.groupBy("part").agg(F.sum("size").alias("p_bytes"), F.count("*").alias("p_rows"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("p_bytes").over(ahead), F.lit(0)).alias("bytes_ahead"),
                         F.coalesce(F.sum("p_rows").over(ahead), F.lit(0)).alias("rows_ahead"),
                         F.sum("p_bytes").over(Window.rowsBetween(Window.unboundedPreceding,
                                                                  Window.unboundedFollowing)).alias("total"))
    offsets = blocks.join(parts, "part").select(
        "part", "block", (F.col("bytes_ahead") + F.col("in_part")).alias("b_bytes"), "rows_ahead", "total")

    within = Window.partitionBy("part", "block").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("b_bytes") + F.coalesce(F.sum("size").over(within), F.lit(0))
    placed = (ranged.join(offsets, ["part", "block"])
              .withColumn("start", start)
              .withColumn("shard", F.expr(f"cast((2 * start + size) * {int(n_shards)} div (2 * total) as int)"))
              .withColumn("place", F.col("rows_ahead") + F.col("idx")))
    first = placed.groupBy(F.col("shard").alias("s")).agg(F.min("place").alias("first"))
    # at most n_shards rows, so the broadcast has a fixed bound
    out = placed.join(F.broadcast(first), F.col("shard") == F.col("s"))
    return out.select(F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), "shard",
                      (F.col("place") - F.col("first")).alias("slot"), *(["carried"] if carry else []))


def write_shards(docs: DataFrame, path: str, n_shards: int = 24, key: str = "doc_id", text: str = "text") -> None:
    """Write the whole rows, one folder per shard, in slot order within a file."""
    out = assign_shards(docs, n_shards, key, text, carry=docs.columns)
    flat = out.select("shard", "slot", "carried")
    (flat.repartitionByRange(max(n_shards, shuffle_partitions(docs.sparkSession)), "shard", "slot")
     .sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path))
