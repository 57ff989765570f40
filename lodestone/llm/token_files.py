"""Token ids as ORC files: integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are dealt by ranges of their ids, so that every file holds one range in ascending order, encoded,
and written with a row index entry for each ``stride`` rows and a Bloom filter on ``doc_id``. Readers prune
files, stripes and strides by these; stripes are read in parallel. A row also has its place in its file, which
run-length encoding stores as one run. Rows that share an id, or have none, are split among files like any others.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.pieces import batches as batches_of
from lodestone.llm.pieces import ragged, split
from lodestone.llm.recall import Recall
from lodestone.llm.scratch import Scratch, tidy
from lodestone.llm.worker import lean

#: Distinct pieces whose ids a generation of a Python worker's memory holds.
REMEMBERED = 400_000
#: A special string of the vocabulary, which stands between pieces that are encoded in one call.
BETWEEN = "<|startoftext|>"
END_ID = 1
#: Text of a file, each row counting for ROW_BYTES besides.
PART_BYTES, ROW_BYTES = 32 << 20, 64
#: Files, and then groups of files and so on, whose sums are added up in one task; three levels reach 2**30 files.
FILES_BITS = 10


class Encoder:
    """Encodes texts piece by piece. The vocabulary drops white space and no pre-token crosses it, so pieces
    between spaces and line ends are encoded on their own, each once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.between = self.model.token_to_id(BETWEEN)
        self.seen = Recall(REMEMBERED)

    def direct(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, new: list[str]) -> None:
        """Ids of each piece, a few hundred to a call with a special string between them."""
        known = self.seen.young
        groups = [new[a : a + 256] for a in range(0, len(new), 256)]
        for group, e in zip(groups, self.model.encode_batch_fast([BETWEEN.join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            ends = [*np.flatnonzero(ids == self.between).tolist(), len(ids)]
            raw, a = ids.tobytes(), 0
            for piece, b in zip(group, ends):
                known[piece] = raw[4 * a : 4 * b]
                a = b + 1

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and each text's number of ids."""
        plain = [t if "<|" not in t else "" for t in texts]
        distinct, at, offsets = split([folded(t).replace("\n", " ") for t in plain], " ")
        if new := self.seen.missing(set(distinct)):
            self.learn(new)
        known = self.seen.young
        runs = [known[p] for p in distinct]
        # texts with something like a special string are encoded whole, as one piece each
        whole = [i for i, t in enumerate(texts) if "<|" in t]
        if whole:
            at = at.copy()
            at[offsets[whole]] = len(runs) + np.arange(len(whole))
            runs += self.direct([texts[i] for i in whole])
        sizes = np.array([len(r) >> 2 for r in runs], np.int64)
        ids = ragged(np.frombuffer(b"".join(runs), "<u4"), np.cumsum(sizes) - sizes, sizes, at)
        return ids, np.add.reduceat(sizes[at], offsets[:-1])


def folded(text: str) -> str:
    """Lower-cased where that changes no id: in Latin-1 texts without special strings. The
    vocabulary's normaliser lower-cases anyway; done first, fewer distinct pieces remain."""
    try:
        text.encode("latin-1")
    except UnicodeError:
        return text
    return text.lower()


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


FILE = "doc_id bigint, place int, ids array<int>"


@lean
def _encode(batches, path: str, end_id: int):
    model, place = encoder(path), 0
    for batch in batches:
        for a, texts in batches_of(batch.column(1)):
            ids, counts = model.encode(texts)
            ends = np.cumsum(counts)
            values = np.insert(ids.astype(np.int32), ends, end_id)
            offsets = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]).astype(np.int32)
            places = np.arange(place, place + len(texts), dtype=np.int32)
            place += len(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(texts)), pa.array(places), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["doc_id", "place", "ids"])


def write_orc(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES, stride: int = 1000) -> None:
    """Writes (doc_id, place, ids) in ascending doc_id order; file names ascend with the ids, places within a file.

    Null text counts as empty: such a document has the end id alone. Rows with equal ids follow one another,
    null ids come first. An empty table gives files without rows. Other columns are not read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total = source.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES)).first()[0] or 0
    parts = max(1, -(-total // part_bytes))
    # rows of one id differ in their number only
    numbered = source.withColumn("number", F.monotonically_increasing_id())
    ordered = numbered.repartitionByRange(parts, "doc_id", "number").sortWithinPartitions("doc_id", "number").select("doc_id", "text")
    writer = (
        ordered.mapInArrow(lambda batches: _encode(batches, tokenizer, end_id), FILE)
        .write.mode("overwrite")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", str(stride))
        .option("orc.stripe.size", str(16 << 20))
        .option("orc.compress", "SNAPPY")
    )
    with tidy(docs.sparkSession):
        writer.orc(path)


def read_orc(spark: SparkSession, path: str, ids: list[int] | None = None) -> DataFrame:
    """The files' rows; with ``ids`` those documents only, by pushed-down filters."""
    found = spark.read.schema(FILE).orc(path)
    return found if ids is None else found.where(F.col("doc_id").isin(list(ids)))


@lean
def _digest(batches):
    for batch in batches:
        column = batch.column("ids")
        offsets = np.asarray(column.offsets)
        values = np.asarray(column.values.fill_null(0)).astype("<u4")
        sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
        own = [batch.column(c) for c in ("doc_id", "place", "file")]
        yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(offsets), pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "place", "file", "n_tokens", "ids_crc32"])


def digest_orc(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files.

    ``start`` counts the ids of all documents before: sums within files, and before them the sums of the earlier
    files of a group, of the earlier groups, and so on, so that no task sees more than a file or 1024 sums.
    """
    number = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")
    rows = read_orc(spark, path).select("doc_id", "place", number.alias("file"), "ids")
    rows = rows.mapInArrow(_digest, "doc_id bigint, place int, file bigint, n_tokens bigint, ids_crc32 bigint")
    # written, so that the files are read once for sums and places
    rows = Scratch(spark, "token-digests").save(rows, "rows")
    sums = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = sums.select("file", F.lit(0).cast("long").alias("before"))
    for level in range(3):
        # of each unit, the ids in earlier units of its group
        group = F.shiftright("unit", FILES_BITS)
        units = sums.groupBy(F.shiftright("file", level * FILES_BITS).alias("unit")).agg(F.sum("n").alias("n")).withColumn("group", group)
        units = units.select("unit", (F.sum("n").over(Window.partitionBy("group").orderBy("unit")) - F.col("n")).alias("add"))
        before = before.withColumn("unit", F.shiftright("file", level * FILES_BITS)).join(units, "unit").select("file", (F.col("before") + F.col("add")).alias("before"))
    order = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
        .join(before, "file")
        .select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
    )
