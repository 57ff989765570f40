"""The thin queries over the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, exact_dedup, html_text, mixing, near_dedup, sharding, substring_dedup, token_counts, token_files, toxicity
from lodestone.llm.scratch import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        F.col("id").alias("doc_id"),
        F.coalesce(toxicity.held_out("id"), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    rounded = [F.round(c, 6).alias(c) for c in ("probability", "weight")]
    return mixed.select(F.col("id").alias("doc_id"), "source", "lang", "topic", "tokens", *rounded, "kept")


MIXTURE_SQL = f"WITH {mixing.mix_sql()}\nSELECT doc_id, source, lang, topic, tokens, round(probability, 6) AS probability, round(weight, 6) AS weight, kept FROM mixed"


def exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="largest").withColumnRenamed("id", "doc_id")


EXACT_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
"""


def near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


NEAR_SQL = r"""
WITH RECURSIVE cut AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, hash(array_to_string(w[p : p + 4], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM cut WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id != b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(x.n) + any_value(y.n) - count(*))),
reach AS (SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.r),
comp AS (SELECT id, min(r) AS c FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c AS component_id, d.doc_id = c AS kept FROM documents d JOIN comp ON comp.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


def substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


SUBSTRINGS_SQL = r"""
WITH cut AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT doc_id, p, hash(array_to_string(w[p : p + 49], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM cut WHERE len(w) >= 50)),
first AS (SELECT g, min(doc_id) AS d FROM win GROUP BY g HAVING count(DISTINCT doc_id) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS q FROM win JOIN first USING (g) WHERE doc_id > d),
lost AS (SELECT doc_id, list(q) AS qs FROM gone GROUP BY doc_id),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS q FROM cut),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY q) AS t FROM word ANTI JOIN gone USING (doc_id, q) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(qs), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM cut LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.judged(scanned).select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


DECONTAMINATION_SQL = r"""
WITH fold AS (
  SELECT 'd' AS kind, CAST(doc_id AS VARCHAR) AS id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL SELECT 'b', CAST(item_id AS VARCHAR), translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
cut AS (SELECT kind, id, coalesce(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM fold),
item AS (SELECT id AS item, w, least(13, len(w)) AS size FROM cut WHERE kind = 'b' AND len(w) > 0),
win AS (SELECT DISTINCT item, size, array_to_string(w[p : p + size - 1], ' ') AS g FROM (SELECT item, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM item)),
sizes AS (SELECT DISTINCT size FROM win),
rolled AS (SELECT id, p, size, array_to_string(w[p : p + size - 1], ' ') AS g
  FROM (SELECT id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM cut, sizes WHERE kind = 'd' AND len(w) >= size)),
hit AS (SELECT r.id, r.p, r.size, w.item FROM rolled r JOIN win w ON r.g = w.g AND r.size = w.size),
words AS (SELECT id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT id, unnest(range(p, p + size)) AS q FROM hit) GROUP BY id),
items AS (SELECT id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS list FROM hit GROUP BY id)
SELECT CAST(c.id AS BIGINT) AS doc_id, CAST(len(c.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(c.w) AS contaminated
FROM cut c LEFT JOIN words USING (id) LEFT JOIN items USING (id) WHERE c.kind = 'd'
"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), shards=40).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "token-orc")
    path = scratch.at("files")
    token_files.write_orc(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    scratch.fade()
    return token_files.digest_orc(spark, path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxic,
    "op2_mixing": mixture,
    "op3_near_dedup": near,
    "op4_exact_dedup": exact,
    "op5_substring_dedup": substrings,
    "op6_decontamination": decontamination,
    "op7_token_counts": tokens,
    "op8_html_text": page_text,
    "op9_sharding": shards,
    "op10_token_orc": token_orc,
}

ORACLES: dict[str, str] = {
    "op2_mixing": MIXTURE_SQL,
    "op3_near_dedup": NEAR_SQL,
    "op4_exact_dedup": EXACT_SQL,
    "op5_substring_dedup": SUBSTRINGS_SQL,
    "op6_decontamination": DECONTAMINATION_SQL,
}
