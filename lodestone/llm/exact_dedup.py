"""Exact dedup by a tree merge of sorted digest runs, in DataFrame operations only.

Every partition first sorts its rows by digest and reduces them to a run of distinct digests with their surviving
identifier and count. The runs then meet in binomial rounds: in each, ``2 ** fused`` neighbouring runs are sent to
where they meet, cut into the same ranges of digests, merged in sorted order, and each digest keeps one
verified identifier. The result is again a sorted run. An exchange thus gets at most one row per digest and run, so
that a text with any number of copies costs no task more than ``2 ** fused`` rows a round, and the last round's single
run still lies in as many tasks as there are slices.

The merge is Spark's sort, which spills sorted pieces and merges them multiway, under an aggregate that reads rows in
their order and holds one digest at a time. Survivors are kept in a structure, for which Spark plans just that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.scratch import Scratch

#: The letters that are folded.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: What tells texts apart, and the bytes of a digest that make a range: 65,536 of them.
KEY, SLICE_BYTES = ["digest", "proof", "bytes"], 2
#: Groups of more rows than LARGE, and than one in HOT of all rows, are looked up by broadcast: fewer than HOT groups.
LARGE, HOT = 100_000, 10_000


def fold_ascii(text: Column) -> Column:
    """Lower-cases A-Z only. Texts that are ASCII throughout take the short way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: its id, SHA-256 of the normalised text, and what a merge verifies besides: a second
    hash of other construction and the length."""
    text = fold_ascii(F.coalesce(F.col(text_col), F.lit("")))
    return (
        docs.select(F.col(id_col).alias("id"), text.alias("norm"))
        .select("id", F.unhex(F.sha2("norm", 256)).alias("digest"), F.xxhash64("norm").alias("proof"), F.octet_length("norm").alias("bytes"))
    )


def merge_runs(rows: DataFrame, runs: int = 64, fused: int = 2, keep: str = "smallest") -> DataFrame:
    """Groups of equal digests: digest, proof, bytes, keep_id, group_size.

    ``runs``: runs that the partitions form, a power of two. ``fused``: binomial rounds taken in one exchange.
    Rows whose digests agree but whose proofs differ are different texts and never merge.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    # nulls are neither the smallest nor the largest of a group that has ids
    survivor = F.struct((F.col("id").isNotNull() if keep == "largest" else F.col("id").isNull()).alias("rank"), F.col("id").alias("id"))
    order = ["run", "slice", *KEY]
    merged = (
        rows.withColumn("run", F.pmod(F.spark_partition_id(), F.lit(runs)))
        .withColumn("slice", F.substring("digest", 1, SLICE_BYTES))
        .groupBy(*order)
        .agg(best(survivor).alias("best"), F.count(F.lit(1)).alias("group_size"))
    )
    left = runs
    while left > 1:
        left = max(1, left >> fused)
        merged = (
            merged.withColumn("run", F.shiftright("run", fused))
            .repartition("run", "slice")
            .groupBy(*order)
            .agg(best("best").alias("best"), F.sum("group_size").alias("group_size"))
        )
    return merged.select(*KEY, F.col("best.id").alias("keep_id"), "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", large: int = LARGE) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty, and empty texts are equal. Ids may repeat: each row is returned, and all rows
    that carry the surviving id are kept. A null id never survives while its group has another; in a group
    of null ids only, all stay. Other columns of ``docs`` are not read, whatever their names.
    An empty table gives an empty result. Rows of groups above ``large`` stay where they are when they learn
    their group; the others meet it by digest.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    rows = scratch.save(digests(docs, id_col, text_col), "digests")
    groups = scratch.save(merge_runs(rows, keep=keep), "groups")
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    is_hot = F.col("group_size") > max(large, total // HOT)
    hot = F.broadcast(groups.where(is_hot))
    cold = rows.join(F.broadcast(groups.where(is_hot).select(*KEY)), KEY, "left_anti").join(groups.where(~is_hot), KEY)
    return rows.join(hot, KEY).unionByName(cold).select(
        "id",
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
