"""Nearest vectors, lexical ranking and rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.text import B, K1, MOST_TERMS, lex_tokens
from lodestone.functions.vectors import cosine

RRF_K = 60


def knn(df: DataFrame, id_col: str, vector_col: str, query: list[float], k: int, where: Column | None = None) -> DataFrame:
    """The k nearest by cosine, exactly: id, score, rank. The prefilter applies before ranking; ties go by id.
    Each task keeps its own k first, so that k rows a task are all that meet."""
    rows = df if where is None else df.where(where)
    q = F.array(*(F.lit(float(x)) for x in query))
    best = rows.select(F.col(id_col).alias("id"), cosine(F.col(vector_col), q).alias("score")).orderBy(F.desc("score"), "id").limit(k)
    return ranked(best, "score")


def ranked(best: DataFrame, by: str) -> DataFrame:
    """Adds rank from 1; for frames of a few rows, such as the first k."""
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), "id")))


def _is(term: str):
    return lambda x: x == F.lit(term)


def bm25(df: DataFrame, id_col: str, text_col: str, query: str, k: int | None, k1: float = K1, b: float = B) -> DataFrame:
    """Okapi scores of documents that hold any of the query's terms: id, score, rank for the first k.

    Texts are cut into terms once. Only terms of the query leave the scan, and all documents without any of them meet
    as one row a task, for the statistics; the statistics and the scores are read from the same exchange.
    """
    spark = df.sparkSession
    terms = spark.range(1).select(F.explode(F.slice(F.array_distinct(lex_tokens(F.lit(query))), 1, MOST_TERMS)).alias("t"))
    wanted = [r["t"] for r in terms.collect()]
    if not wanted:
        return df.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    names = [f"tf_{i}" for i in range(len(wanted))]
    tokens = df.select(F.col(id_col).alias("id"), lex_tokens(F.col(text_col)).alias("tokens"))
    found = tokens.select("id", F.size("tokens").alias("dl"), F.filter("tokens", lambda t: t.isin(wanted)).alias("found"))
    hit = F.size("found") > 0
    # a number of its own for each document with a hit, since ids may repeat; none for all others
    rows = found.groupBy(F.when(hit, F.col("id")).alias("id"), F.when(hit, F.monotonically_increasing_id()).alias("row"))
    counted = rows.agg(F.count(F.lit(1)).alias("docs"), F.sum("dl").alias("dl"), *(F.sum(F.size(F.filter("found", _is(t)))).alias(n) for n, t in zip(names, wanted)))
    stats = counted.agg(F.sum("docs").alias("n"), (F.sum("dl") / F.sum("docs")).alias("avgdl"), *(F.sum((F.col(n) > 0).cast("long")).alias(f"d{n}") for n in names))
    hits = counted.where("docs > 0 and (" + " or ".join(f"{n} > 0" for n in names) + ")").crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for n in names:
        tf, dfi = F.col(n).cast("double"), F.col(f"d{n}")
        idf = F.log(1 + (F.col("n") - dfi + 0.5) / (dfi + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = hits.select("id", score.alias("score"))
    return scored if k is None else ranked(scored.orderBy(F.desc("score"), "id").limit(k), "score")


def rrf(channels: list[DataFrame], k: int = RRF_K, top: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of (id, rank) frames: id, score; ties by id."""
    every = channels[0].select("id", "rank")
    for c in channels[1:]:
        every = every.unionByName(c.select("id", "rank"))
    fused = every.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))
    return fused if top is None else fused.orderBy(F.desc("score"), "id").limit(top)


def recent(df: DataFrame, at: str, id_col: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(at), id_col).limit(k)


def fetch(hits: DataFrame, docs: DataFrame, id_col: str, owner_col: str | None = None, owner: str | None = None) -> DataFrame:
    """Documents of hits in rank order; ids without a document fall out, and so do other owners' documents."""
    rows = docs if owner is None else docs.where(F.col(owner_col) == owner)
    return rows.join(F.broadcast(hits.select(F.col("id").alias(id_col), "rank")), id_col).orderBy("rank")
