"""From raw documents to training shards: toxicity, near duplicates, contamination, mixture, shards.

Each stage takes what its predecessor kept, written as Parquet and read again, and returns the documents it
keeps; the last returns each document's place. Stages decide by row: rows without an id, or with a repeated one,
are documents of their own, and of rows that share id and text one is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, mixing, near_dedup, sharding, toxicity
from lodestone.llm.scratch import Scratch


def keyed(docs: DataFrame) -> DataFrame:
    """Adds __row, a key of its own for each row. It is the id; rows without one, and all but one of those that share
    one, get numbers above all ids, or below them where there is no room. Numbers are written once."""
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("doc_id is null or n > 1")
    if odd.isEmpty():
        return docs.withColumn("__row", F.col("doc_id").cast("long"))
    scratch = Scratch(docs.sparkSession, "row-keys")
    rows = scratch.save(docs.withColumn("__n", F.monotonically_increasing_id()), "rows")
    least, most, last = rows.agg(F.min(F.col("doc_id").cast("long")), F.max(F.col("doc_id").cast("long")), F.max("__n")).first()
    least, most, span = min(least or 0, 0), max(most or 0, 0), last + 1
    # the smallest key of like rows is kept: rows without an id come last
    place = F.col("__n") + F.when(F.col("doc_id").isNull(), F.lit(span)).otherwise(F.lit(0))
    if most + 2 * span < 1 << 63:
        number = F.lit(most + 1) + place
    elif least - 2 * span >= -(1 << 63):
        number = F.lit(least - 2 * span) + place
    else:
        raise ValueError("the ids leave no numbers for rows without an id or with a repeated one")
    first = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("__n").alias("__n")).select("__n", F.lit(True).alias("__first"))
    key = F.when(F.col("__first"), F.col("doc_id").cast("long")).otherwise(number)
    return scratch.save(rows.join(first, "__n", "left").select(*docs.columns, key.alias("__row")), "keyed")


def without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows whose key isn't in ``dropped``, without their key."""
    return rows.join(dropped.select(F.col("id").alias("__row")), "__row", "left_anti").drop("__row")


def single(rows: DataFrame) -> DataFrame:
    """One row of those that share id and text."""
    if (later := rows.where(F.col("__row") != F.col("doc_id"))).isEmpty():
        return rows
    best = F.min(F.struct((F.col("__row") != F.col("doc_id")).alias("later"), "__row")).alias("best")
    kept = rows.where("doc_id is not null").groupBy("doc_id", F.sha2("text", 256)).agg(best).select("best.__row")
    again = later.select("__row").join(kept, "__row", "left_anti")
    return Scratch(rows.sparkSession, "single-rows").save(rows.join(again, "__row", "left_anti"), "rows")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = single(keyed(docs))
    return without(rows, near_dedup.near_duplicates(rows, id_col="__row").where("not kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = keyed(docs)
    return without(rows, decontaminate.judged(decontaminate.scan(rows, benchmark, id_col="__row")).where("contaminated"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = keyed(docs)
    return without(rows, mixing.mix(rows, id_col="__row").where("not kept"))


def place(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixture", mix_sources),
    ("sharding", place),
]

#: A compression distance can't be had in SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
