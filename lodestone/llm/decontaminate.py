"""Benchmark decontamination with a broadcast hash set of normalised n-grams.

Words are runs of ASCII letters and digits and of any non-ASCII character, after lower-casing A-Z. Every
window of ``n`` consecutive words of a benchmark item is in the set; an item of fewer words, but not none,
is one window of its own length. Training texts are scanned once: rolling window hashes are looked up in
the set, each hit is verified word for word, and the hit words are spans to remove.

The set is broadcast in blocks of at most ``block_bytes`` of benchmark text. One block is the usual case;
a larger benchmark costs one scan per block, and the blocks' spans are merged per row: rows get numbers of
their own, which are written once, before the scans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import wordhash as wh
from lodestone.llm.scratch import Scratch
from lodestone.llm.worker import lean

N_WORDS = 13
#: Benchmark text per broadcast set; its windows take about 60 times as much on an executor.
BLOCK_BYTES = 2 << 20
SCAN = "id bigint, row bigint, n_words bigint, spans array<struct<a:int,b:int>>, items array<string>"


class WindowSet:
    """Windows of some benchmark items: by length, the sorted hashes; by hash, the items of each text that has it."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        found: dict[int, dict[int, dict[bytes, set[str]]]] = {}
        texts = pa.array([t for _, t in items], pa.string())
        for part in wh.slices(texts, wh.FOLD, wh.ALNUM):
            hashes = part.hashes()
            for r in range(part.rows):
                a, b = int(part.begins[r]), int(part.begins[r + 1])
                if a == b:
                    continue
                size = min(n, b - a)
                for k, h in enumerate(wh.grams(hashes[a:b], size).tolist()):
                    found.setdefault(size, {}).setdefault(h, {}).setdefault(part.text(a + k, a + k + size), set()).add(items[part.first + r][0])
        self.windows = found
        self.sorted = {size: np.array(sorted(w), np.uint64) for size, w in found.items()}
        # a bit per leading 16 bits of a hash: most lookups end there
        self.first = {size: np.bincount((h >> np.uint64(48)).astype(np.int64), minlength=1 << 16) > 0 for size, h in self.sorted.items()}

    def hits(self, words: wh.Words) -> Iterator[tuple[int, int, set[str]]]:
        """(position, length, items) of each verified window; positions count the slice's words."""
        hashes = words.hashes()
        for size, known in self.sorted.items():
            rolling = wh.grams(hashes, size)
            at = np.flatnonzero(self.first[size][(rolling >> np.uint64(48)).astype(np.int64)])
            near = np.searchsorted(known, rolling[at])
            at = at[known[np.minimum(near, len(known) - 1)] == rolling[at]]
            at = at[words.row[at] == words.row[at + size - 1]]
            for p in at.tolist():
                items = self.windows[size][int(rolling[p])].get(words.text(p, p + size))
                if items:
                    yield p, size, items


@lean
def _scan(batches, known: WindowSet):
    for batch in batches:
        for words in wh.slices(batch.column("text"), wh.FOLD, wh.ALNUM):
            spans: dict[int, list[list[int]]] = {}
            items: dict[int, set[str]] = {}
            for p, size, which in sorted(known.hits(words), key=lambda h: h[0]):
                r = int(words.row[p])
                a = p - int(words.begins[r])
                mine = spans.setdefault(r, [])
                if mine and a <= mine[-1][1]:
                    mine[-1][1] = max(mine[-1][1], a + size)
                else:
                    mine.append([a, a + size])
                items.setdefault(r, set()).update(which)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").slice(words.first, words.rows),
                    batch.column("row").slice(words.first, words.rows),
                    pa.array(words.counts, pa.int64()),
                    pa.array([[{"a": a, "b": b} for a, b in spans.get(r, ())] for r in range(words.rows)], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
                    pa.array([sorted(items.get(r, ())) for r in range(words.rows)], pa.list_(pa.string())),
                ],
                ["id", "row", "n_words", "spans", "items"],
            )


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    block, size = [], 0
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item is not null and text is not null")
    for row in rows.toLocalIterator(prefetchPartitions=False):
        block.append((row["item"], row["text"]))
        size += len(row["text"].encode())
        if size >= block_bytes:
            yield block
            block, size = [], 0
    yield block


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: id, n_words, spans (of hit words, disjoint, ascending), items (ids of the items
    whose windows occur, sorted as strings).

    Null texts have no words. Rows without an id, and rows with equal ids, stay apart, however many blocks the
    benchmark needs. Items without id or words have no windows; several items may share a window. An empty
    benchmark hits nothing. Other columns are not read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    block, after = next(blocks), next(blocks, None)
    if one := after is None:
        source = source.select("id", F.lit(0).cast("long").alias("row"), "text")
    else:
        source = Scratch(docs.sparkSession, "decontaminate").save(source.select("id", F.monotonically_increasing_id().alias("row"), "text"), "rows")
    found = None
    while block is not None:
        known = docs.sparkSession.sparkContext.broadcast(WindowSet(block, n))
        part = source.mapInArrow(lambda batches, known=known: _scan(batches, known.value), SCAN)
        found = part if found is None else found.unionByName(part)
        block, after = after, next(blocks, None)
    if one:
        return found.drop("row")
    merged = F.expr("""aggregate(array_sort(flatten(collect_list(spans))), cast(array() as array<struct<a:int,b:int>>), (done, x) ->
        if(size(done) > 0 and x.a <= element_at(done, -1).b,
           concat(slice(done, 1, size(done) - 1), array(named_struct('a', element_at(done, -1).a, 'b', greatest(element_at(done, -1).b, x.b)))),
           concat(done, array(x))))""")
    items = F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    return found.groupBy("row").agg(F.first("id").alias("id"), F.max("n_words").alias("n_words"), merged.alias("spans"), items).drop("row")


def judged(scanned: DataFrame) -> DataFrame:
    """Adds n_hit and contaminated: at least one word in twenty is hit."""
    return scanned.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    )


@lean
def _cut(batches):
    """Removes the hit words from texts; what stands between kept words stays."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        spans = batch.column("spans").to_pylist()
        out: list = list(texts)
        for words in wh.slices(batch.column("text"), wh.FOLD, wh.ALNUM):
            for r in range(words.rows):
                cut = spans[words.first + r]
                if not cut:
                    continue
                raw = texts[words.first + r].encode()
                begin = int(words.begins[r])
                # offsets in the row, whose first byte follows all earlier rows and their separators
                base = sum(len((texts[words.first + k] or "").encode()) + 1 for k in range(r))
                parts, at = [], 0
                for s in cut:
                    parts.append(raw[at : int(words.starts[begin + s["a"]]) - base])
                    at = int(words.ends[begin + s["b"] - 1]) - base
                out[words.first + r] = b"".join([*parts, raw[at:]]).decode()
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.string())], ["id", "text"])


def remove_spans(docs: DataFrame, scanned: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and text without its hit words; rows without hits keep their text as it is."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.join(scanned.select("id", "spans"), "id").select("id", "text", "spans").mapInArrow(_cut, "id bigint, text string")


def remove_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns. Rows without an id stay."""
    bad = judged(scan(docs, benchmark, id_col=id_col, **options)).where("contaminated").select(F.col("id").alias("__contaminated"))
    return docs.join(bad, docs[id_col] == F.col("__contaminated"), "left_anti")
