"""Agent memory: session logs, rolling summaries, long-term facts, hybrid search, dedup."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.text import bm25_embed, lex_text, memory_hash
from lodestone.operators import topk
from lodestone.plans.errors import invalid

KEEP_PERCENT, SUMMARY_CHARS, SUMMARY_ENTRIES, EXTRACT_EVERY = 40, 8000, 2, 6
#: Vectors that a block of a comparison holds.
BLOCK = 4096
CHANNEL, DEFAULT_LIMIT, MOST_LIMIT, DEDUP_COSINE = 12, 10, 50, 0.85


def sessions(turns: DataFrame, session: str, seq: str, content: str) -> DataFrame:
    """One row per session: its entries in order."""
    entries = F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("seq"), F.col(content).alias("content")))), lambda e: e)
    return turns.groupBy(session).agg(entries.alias("entries"))


def written(log: DataFrame, session: str, seq: str, content: str, op: str, at: str, ttl: Column | None = None, now: Column | None = None) -> DataFrame:
    """The entries that a log of writes leaves: (session, seq, content). ``op`` is append, edit, delete or clear, which
    drops all that was written to the session before; ``at`` orders the writes. An edit or delete of an entry that isn't
    there changes nothing. With a time to live, a session ends that long after its last write."""
    last = log.groupBy(session).agg(F.max(F.when(F.col(op) == "clear", F.col(at))).alias("__cleared"), F.max(at).alias("__touched"))
    live = log.where(F.col(op) != "clear").join(last, session).where(F.col("__cleared").isNull() | (F.col(at) > F.col("__cleared")))
    if ttl is not None:
        live = live.where(F.col("__touched") + ttl > now)
    # what an entry is depends on its writes from the last append on
    best = F.max(F.when(F.col(op) == "append", F.col(at))).alias("__began")
    began = live.groupBy(session, seq).agg(best).where("__began is not null")
    writes = live.join(began, [session, seq]).where(F.col(at) >= F.col("__began"))
    state = writes.groupBy(session, seq).agg(F.max_by(F.struct(F.col(op).alias("op"), F.col(content).alias("content")), at).alias("w"), F.max((F.col(op) == "delete").cast("int")).alias("gone"))
    return state.where("gone = 0").select(session, seq, F.col("w.content").alias(content))


def extract(turns: DataFrame, session: str, seq: str, content: str, strategy: str | Callable[[Column], Column] = "discrete") -> DataFrame:
    """(session, fact): facts of a session's text by a strategy, each once. A strategy is a column function of the joined
    text that gives an array, such as one that calls a model; ``discrete`` takes sentences, ``summary`` the whole text
    and ``preferences`` sentences that state one."""
    sentences = lambda t: F.filter(F.transform(F.split(t, r"(?<=[.!?])\s+|\n+"), F.trim), lambda s: s != "")
    known = {
        "discrete": sentences,
        "summary": lambda t: F.filter(F.array(F.trim(t)), lambda s: s != ""),
        "preferences": lambda t: F.filter(sentences(t), lambda s: s.rlike(r"(?i)\b(prefer|like|love|hate|want|favou?rite)")),
    }
    if isinstance(strategy, str) and strategy not in known:
        raise invalid(f"unknown strategy {strategy}")
    made = known[strategy] if isinstance(strategy, str) else strategy
    ordered = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("seq"), F.coalesce(F.col(content), F.lit("")).alias("content"))))
    text = turns.groupBy(session).agg(F.array_join(F.transform(ordered, lambda e: e["content"]), "\n").alias("text"))
    return text.select(session, F.explode(F.array_distinct(made(F.col("text")))).alias("fact"))


def summary_split(turns: DataFrame, session: str, seq: str, content: str, percent: int = KEEP_PERCENT) -> DataFrame:
    """Adds part: the newest entries are kept until they hold ``percent`` of the session's characters, in whole
    characters, and at least one is; the older ones are to be summarised."""
    chars = F.char_length(F.coalesce(F.col(content), F.lit("")))
    newest = Window.partitionBy(session).orderBy(F.desc(seq))
    newer = F.coalesce(F.sum(chars).over(newest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum(chars).over(Window.partitionBy(session))
    return turns.withColumn("part", F.when((F.row_number().over(newest) == 1) | (newer < F.floor(total * percent / 100)), "keep").otherwise("summarise"))


def due(turns: DataFrame, session: str, seq: str, content: str) -> DataFrame:
    """By session: entries, chars, how often extraction was due, and whether a summary is."""
    chars = F.char_length(F.coalesce(F.col(content), F.lit("")))
    g = turns.groupBy(session).agg(F.count(F.lit(1)).alias("entries"), F.sum(chars).alias("chars"))
    return g.withColumn("extractions", F.floor(F.col("entries") / EXTRACT_EVERY)).withColumn("summary_due", (F.col("chars") >= SUMMARY_CHARS) & (F.col("entries") >= SUMMARY_ENTRIES))


def summarise(turns: DataFrame, session: str, seq: str, content: str, summariser: Callable[[Column], Column] | None = None) -> DataFrame:
    """By session: summary of the older entries and the kept ones. The summariser is any column function of the joined
    text; by default it is the text itself."""
    split = summary_split(turns, session, seq, content)
    ordered = lambda part: F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == part, F.struct(F.col(seq).alias("seq"), F.col(content).alias("content"))))), lambda e: e["content"])
    g = split.groupBy(session).agg(F.array_join(ordered("summarise"), "\n").alias("old"), ordered("keep").alias("kept"))
    return g.select(session, (summariser or (lambda c: c))(F.col("old")).alias("summary"), "kept")


def forget(memories: DataFrame, ids: DataFrame, owner: str | None = None) -> DataFrame:
    """The memories without those named; an owner can forget no other's."""
    gone = ids.select(F.col(ids.columns[0]).alias("id")).distinct()
    if owner is not None:
        gone = gone.join(memories.where(F.col("owner") == owner).select("id"), "id", "left_semi")
    return memories.join(gone, "id", "left_anti")


def remembered(rows: DataFrame, id_col: str, content: str, owner: Column | None = None, kind: str = "note") -> DataFrame:
    """Long-term rows with their derived columns: hash, lexical text and vector are written with the row."""
    own = F.lit("default") if owner is None else F.coalesce(owner, F.lit("default"))
    c = F.col(content)
    return rows.select(F.col(id_col).alias("id"), c.alias("content"), F.lit(kind).alias("type"), own.alias("owner"), memory_hash(c).alias("memory_hash"), lex_text(c).alias("lex"), bm25_embed(c).alias("vector"))


def check_tags(tags: list[str]) -> list[str]:
    if any("," in t for t in tags):
        raise invalid("tags can't hold commas")
    return tags


def limited(limit: int | None) -> int:
    limit = DEFAULT_LIMIT if limit is None or limit < 1 else limit
    return min(limit, MOST_LIMIT)


def search(memories: DataFrame, query: str, vector: list[float] | None, mode: str = "HYBRID", owner: str | None = None, limit: int | None = None, reranker: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(id, score, rank). The owner's rows only, before any ranking. Without a vector, or with a zero one, meaning
    falls back to words."""
    n = limited(limit)
    rows = memories if owner is None else memories.where(F.col("owner") == owner)
    dense = vector is not None and any(vector)
    if mode == "KEYWORD" or not dense:
        return topk.bm25(rows, "id", "content", query, n)
    if mode == "SEMANTIC":
        return topk.knn(rows, "id", "vector", vector, n)
    fused = topk.rrf([topk.knn(rows, "id", "vector", vector, CHANNEL), topk.bm25(rows, "id", "content", query, CHANNEL)], top=CHANNEL)
    fused = reranker(fused) if reranker else fused
    return topk.ranked(fused.orderBy(F.desc("score"), "id").limit(n), "score")


def contains(memories: DataFrame, text: str, at: str, k: int) -> DataFrame:
    """Case-sensitive containment, newest first: what keyword search falls back to."""
    return topk.recent(memories.where(F.col("content").contains(text)), at, "id", k)


def dedup(new: DataFrame, stored: DataFrame, threshold: float = DEDUP_COSINE) -> DataFrame:
    """New memories that are neither stored already, by content hash, nor close to a stored one of the same owner.

    The new ones are a query set that is held against all stored rows of their owner, exactly: both are cut into blocks
    of at most about BLOCK rows, by owner and a hash of the id, and each pair of blocks is one product of matrices.
    Vectors of another length, or without any, are close to nothing.
    """
    fresh = new.join(stored.select("owner", "memory_hash"), ["owner", "memory_hash"], "left_anti").dropDuplicates(["owner", "memory_hash"])
    cuts = lambda df, name: df.groupBy("owner").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    sizes = cuts(fresh, "a").join(cuts(stored, "b"), "owner")
    own = lambda df: df.select("id", "owner", F.col("vector").cast("array<double>").alias("vector")).join(sizes, "owner")
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = own(fresh).select("id", "owner", "vector", block("a").alias("i"), every("b").alias("j"), F.lit(True).alias("asked"))
    known = own(stored).select("id", "owner", "vector", every("a").alias("i"), block("b").alias("j"), F.lit(False).alias("asked"))
    kind = dict(fresh.dtypes)["id"]
    near = asked.unionByName(known).groupBy("owner", "i", "j").applyInArrow(lambda t: _close(t, threshold), f"id {kind}").distinct()
    return fresh.join(near, "id", "left_anti")


def _close(rows: pa.Table, threshold: float) -> pa.Table:
    """Ids of asked rows with a known one within the threshold."""
    kept = []
    asked = np.asarray(rows.column("asked").combine_chunks().cast(pa.int8())) > 0
    vectors = rows.column("vector").combine_chunks()
    length = np.asarray(vectors.value_lengths().fill_null(0))
    for n in np.unique(length[asked]):
        if n:
            of = np.flatnonzero(length == n)
            m = np.asarray(vectors.take(pa.array(of)).flatten().fill_null(0.0)).reshape(len(of), n)
            norm = np.sqrt((m * m).sum(axis=1))
            unit = m / np.where(norm > 0, norm, 1)[:, None]
            mine = asked[of]
            if (~mine).any():
                kept += of[np.flatnonzero(mine)[(unit[mine] @ unit[~mine].T).max(axis=1) >= threshold]].tolist()
    return pa.table({"id": rows.column("id").take(pa.array(kept, pa.int64()))})
