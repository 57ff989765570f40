"""Sharding by longest-processing-time scheduling.

Rows of one group (equal texts) must stay together. The scheduler places units, largest first, on the
least loaded shard, which a heap gives. A group of at least ``total / (shards * grain)`` bytes is a unit of
its own; there can be no more than ``shards * grain`` of those. All smaller groups are dealt by hash into
``shards * grain`` bundles. So at most ``2 * shards * grain`` units exist at any size of the input: that is
the proven bound of what the driver holds and what is broadcast, and the shards' sizes differ by about one
bundle unless a single group is larger than a shard's share, which no law can split.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestone.llm.scratch import Scratch

#: Bytes that a row takes besides its text.
ROW_BYTES = 16
#: Rows of a slice of a shard in which positions are counted.
SLICE_ROWS, SLICES = 4096, 64


def schedule(units: list[tuple[int, int]], shards: int) -> list[int]:
    """Shard of each (size, rows) unit: longest first, to the least loaded shard. Equal loads: fewer rows, then
    the lower number; equal units: in the order given."""
    heap = [(0, 0, s) for s in range(shards)]
    out = [0] * len(units)
    for i in sorted(range(len(units)), key=lambda i: (-units[i][0], -units[i][1], i)):
        load, rows, s = heap[0]
        out[i] = s
        heapq.heapreplace(heap, (load + units[i][0], rows + units[i][1], s))
    return out


def assign_shards(docs: DataFrame, shards: int = 40, grain: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, shard, slot.

    ``size`` is the text's UTF-8 bytes plus 16; null text counts as empty and shares the group of empty texts.
    ``slot`` numbers the rows of a shard from 0 without gaps. Repeated rows are rows of their own; a null id
    is placed like any other. Columns besides id and text are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = scratch.save(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("grp"),
        ),
        "rows",
    )
    count, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    bundles = shards * grain
    least = max(1, -(-total // bundles))
    groups = rows.groupBy("grp").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    bundle = F.pmod(F.xxhash64("grp"), F.lit(bundles)).cast("int")
    large = F.col("size") >= F.lit(least)
    # at most 2 * shards * grain rows, see above
    units = (
        groups.groupBy(F.when(~large, bundle).alias("bundle"), F.when(large, F.col("grp")).alias("grp"))
        .agg(F.sum("size").alias("size"), F.sum("n").alias("n"))
        .collect()
    )
    units.sort(key=lambda u: (u["bundle"] is None, u["bundle"] or 0, bytes(u["grp"] or b"")))
    placed = list(zip(units, schedule([(u["size"], u["n"]) for u in units], shards)))
    by_group = spark.createDataFrame(
        [(u["grp"], s) for u, s in placed if u["grp"] is not None],
        T.StructType([T.StructField("grp", T.BinaryType()), T.StructField("own", T.IntegerType())]),
    )
    by_bundle = spark.createDataFrame([(u["bundle"], s) for u, s in placed if u["grp"] is None], "bundle int, common int")
    dealt = (
        rows.withColumn("bundle", bundle)
        .join(F.broadcast(by_group), "grp", "left")
        .join(F.broadcast(by_bundle), "bundle", "left")
        .select("id", "size", "text_crc32", F.coalesce("own", "common").alias("shard"))
        # rows without an id are told apart by their number, which the table written next keeps
        .withColumn("number", F.when(F.col("id").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(0)))
        .withColumn("slice", F.pmod(F.xxhash64("id", "text_crc32", "number"), F.lit(max(SLICES, -(-count // SLICE_ROWS)))))
        .drop("number")
    )
    dealt = scratch.save(dealt, "dealt")
    before = (
        dealt.groupBy("shard", "slice")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("slice")) - F.col("n"))
        .drop("n")
    )
    place = F.row_number().over(Window.partitionBy("shard", "slice").orderBy("id", "text_crc32", "size"))
    return (
        dealt.withColumn("place", place)
        .join(before, ["shard", "slice"])
        .select("id", "size", "text_crc32", "shard", (F.col("before") + F.col("place") - 1).cast("long").alias("slot"))
    )
