"""Substring dedup by fixed-block anchors.

Every document is cut into non-overlapping reference blocks of 25 words. A run of 50 words holds at least one
whole block of the document it stands in, wherever it begins; so a run that two documents share shows as a
block of one that some rolling window of the other equals. All windows probe all blocks:

1. anchors: rolling 25-word hashes are dealt by hash to parts. In a part, those at block starts are the index,
   and all others probe it. Hits mark a place in either document.
2. extension: around hits, and only there, the hashes of the 50-word windows are dealt in the same way, and
   each window learns the smallest document it starts in. Windows that overlap join to maximal repeats. Here
   windows are equal if two independent hashes, of 96 bits together, are, so that no chance match is to be
   expected at any size; anchors are only places to look at.
3. removal: words that such windows cover are cut from all documents but the smallest of each window.

A buffer of about 8 MB of text first settles what its own documents share. Of equal hashes of 50 words only the
smallest document's are sent on. Of equal hashes of 25 words that several documents have, all of which are marked
there, two places are: the smallest document's that is a block, for larger documents elsewhere, and the largest
document's, for smaller ones whose block it is. (The smallest document's, where it is no block, would be in no index
and is below the largest.) A passage that stands in every document is thus sent once or twice per buffer, not once
per document. Parts are as many as the text has 8 MB, so that a task's memory doesn't depend on the corpus. A buffer
deals to ``FAN`` ranges of hashes at most; of more parts, each range is dealt once more, so that what a part gets
from a buffer stays large.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import wordhash as wh
from lodestone.llm.scratch import Scratch
from lodestone.llm.worker import lean

WINDOW = 50
BLOCK = WINDOW // 2
BUFFER_BYTES = 8 << 20
LEAST_PARTS = 64
#: Ranges of hashes that buffers deal to at once.
FAN = 4096
#: Of the two hashes that tell windows apart, of 64 bits and of 32.
SEEDS = (0, 0x5851F42D4C957F2D)
DEALT = "part int, found binary, id bigint"


def planes(values: np.ndarray, width: int) -> bytes:
    """Integers byte by byte, all lowest bytes first: small values compress to little."""
    return np.ascontiguousarray(values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def unplanes(raw: np.ndarray, n: int, width: int) -> np.ndarray:
    return np.ascontiguousarray(raw[: n * width].reshape(width, n).T).view(f"<u{width}").ravel()


def pack(keys: list[np.ndarray], widths: tuple[int, ...], row: np.ndarray, pos: np.ndarray, ids: np.ndarray) -> bytes:
    """Keys with the rows and places they come from, in that order; ``ids`` of rows go along."""
    used, row = np.unique(row, return_inverse=True)
    head = np.array([len(row), len(used)], "<u4").tobytes()
    own = ids[used].astype(np.int64)
    return b"".join([head, *map(planes, keys, widths), planes(np.diff(row, prepend=0), 4), planes(pos, 4), planes(np.diff(own, prepend=0).view(np.uint64), 8)])


def unpack(blob: bytes, widths: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Keys, ids and places."""
    n, m = np.frombuffer(blob, "<u4", 2).tolist()
    raw = np.frombuffer(blob, np.uint8, offset=8)
    keys = []
    for width in widths:
        keys.append(unplanes(raw, n, width))
        raw = raw[n * width :]
    row, raw = np.cumsum(unplanes(raw, n, 4).astype(np.int64)), raw[4 * n :]
    pos, raw = unplanes(raw, n, 4), raw[4 * n :]
    return keys, np.cumsum(unplanes(raw, m, 8).view(np.int64))[row], pos


def unpacked(blobs: list[bytes], widths: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Of several blobs, one after another."""
    keys, ids, pos = zip(*(unpack(b, widths) for b in blobs))
    return [np.concatenate(k) for k in zip(*keys)], np.concatenate(ids), np.concatenate(pos)


def groups(keys: list[np.ndarray]) -> np.ndarray:
    """Numbers from 0 on, equal where all keys are."""
    if len(keys) == 1:
        return np.unique(keys[0], return_inverse=True)[1]
    order = np.lexsort(keys)
    new = np.zeros(len(order), np.int64)
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def by_id(ids: np.ndarray, pos: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Places of each id, packed."""
    order = np.lexsort((pos, ids))
    ids, pos = ids[order], pos[order]
    edges = np.flatnonzero(np.diff(ids)) + 1 if len(ids) else np.zeros(0, int)
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(ids)]):
        if b > a:
            yield int(ids[a]), pos[a:b].astype("<u4").tobytes()


def rows(parts: list, found: list, ids: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(found, pa.binary()), pa.array(ids, pa.int64())], ["part", "found", "id"])


def deal(keys: list[np.ndarray], widths: tuple[int, ...], row: np.ndarray, pos: np.ndarray, ids: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Keys by the range that the first one's upper half falls in."""
    part = ((keys[0] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    edges = np.flatnonzero(np.diff(part[order], prepend=-1))
    out = list(zip(part[order[edges]].tolist(), np.split(order, edges[1:]))) if len(order) else []
    for a in range(0, len(out), 32):
        some = out[a : a + 32]
        yield rows([p for p, _ in some], [pack([k[o] for k in keys], widths, row[o], pos[o], ids) for _, o in some], [None] * len(some))


class Buffer:
    """Hashes of some documents' windows. ``flush`` settles what they share and deals the rest to parts."""

    def __init__(self, parts: int, widths: tuple[int, ...], both: bool):
        self.parts, self.widths, self.both = parts, widths, both
        self.clear()

    def clear(self) -> None:
        self.hashes, self.row, self.pos, self.ids, self.size = [], [], [], [], 0

    def add(self, hashes: list[np.ndarray], row: np.ndarray, pos: np.ndarray, ids: np.ndarray, size: int) -> None:
        self.hashes.append(hashes)
        self.row.append(row + sum(map(len, self.ids)))
        self.pos.append(pos)
        self.ids.append(ids)
        self.size += size

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.ids:
            return
        row, pos, ids = map(np.concatenate, (self.row, self.pos, self.ids))
        hashes = [np.concatenate(h) for h in zip(*self.hashes)]
        self.clear()
        send = np.ones(len(row), bool)
        # hashes that occur more than once here
        run = groups(hashes)
        times = np.bincount(run)
        at = np.flatnonzero(times[run] > 1)
        if len(at):
            doc, run = ids[row[at]], run[at]
            first = np.full(len(times), np.iinfo(np.int64).max)
            np.minimum.at(first, run, doc)
            later = doc > first[run]
            if self.both:
                shared = np.zeros(len(first), bool)
                shared[run[later]] = True
                later = shared[run]
                send[at[later]] = False
                # these have their anchors; other buffers need the smallest block and the largest document
                some = np.flatnonzero(later)
                some = some[np.lexsort((doc[some], run[some]))]
                send[at[some[np.diff(run[some], append=-1) != 0]]] = True
                some = some[pos[at[some]] % BLOCK == 0]
                send[at[some[np.diff(run[some], prepend=-1) != 0]]] = True
            else:
                send[at[later]] = False
            own = list(by_id(doc[later], pos[at[later]]))
            yield rows([i % self.parts for i, _ in own], [f for _, f in own], [i for i, _ in own])
        yield from deal([h[send] for h in hashes], self.widths, row[send], pos[send], ids, self.parts)


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("id")).astype(np.int64)


@lean
def _anchors(batches, parts: int, widths: tuple[int, ...]):
    buffer = Buffer(parts, widths, both=True)
    for batch in batches:
        ids = _ids(batch)
        for words in wh.slices(batch.column("text"), wh.KEEP, wh.SPACED):
            hashes = wh.grams(words.hashes(), BLOCK)
            at = np.flatnonzero(wh.within(words, BLOCK))
            row = words.row[at]
            buffer.add([hashes[at]], row, at - words.begins[row], ids[words.first : words.first + words.rows], len(words.data))
            if buffer.size >= BUFFER_BYTES:
                yield from buffer.flush()
    yield from buffer.flush()


def _probe(keys: list[np.ndarray], ids: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Windows that are blocks of a smaller document, and blocks that are windows of a larger one."""
    (keys,) = keys
    block = pos % BLOCK == 0
    index, which = np.unique(keys[block], return_inverse=True)
    if not len(index):
        return np.zeros(0, np.int64)
    least = np.full(len(index), np.iinfo(np.int64).max)
    np.minimum.at(least, which, ids[block])
    at = np.minimum(np.searchsorted(index, keys), len(index) - 1)
    hit = np.flatnonzero(index[at] == keys)
    at = at[hit]
    most = np.full(len(index), np.iinfo(np.int64).min)
    np.maximum.at(most, at, ids[hit])
    return hit[(ids[hit] > least[at]) | (block[hit] & (ids[hit] < most[at]))]


@lean
def _windows(batches, parts: int, widths: tuple[int, ...]):
    buffer = Buffer(parts, widths, both=False)
    for batch in batches:
        ids, found = _ids(batch), batch.column("found")
        for words in wh.slices(batch.column("text"), wh.KEEP, wh.SPACED):
            known = words.hashes()
            hashes = [wh.grams(known, WINDOW, seed) for seed in SEEDS]
            whole = wh.within(words, WINDOW)
            near = np.zeros(len(words.row) + 1, np.int64)
            for r in range(words.rows):
                hits = np.unique(np.frombuffer(b"".join(found[words.first + r].as_py()), "<u4").astype(np.int64))
                # windows that hold the 25 words at a hit begin at most 25 words before it
                begin = int(words.begins[r])
                np.add.at(near, begin + np.maximum(hits - BLOCK, 0), 1)
                np.add.at(near, begin + hits + 1, -1)
            at = np.flatnonzero(whole & (np.cumsum(near)[: len(whole)] > 0))
            row = words.row[at]
            buffer.add([h[at] for h in hashes], row, at - words.begins[row], ids[words.first : words.first + words.rows], len(words.data))
            if buffer.size >= BUFFER_BYTES:
                yield from buffer.flush()
    yield from buffer.flush()


def _extend(keys: list[np.ndarray], ids: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Windows that start in a smaller document too."""
    which = groups(keys)
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, which, ids)
    return np.flatnonzero(ids > least[which])


def _settled(group: pa.Table, widths: tuple[int, ...], rule) -> pa.Table:
    """What buffers settled themselves goes through; the rest is unpacked for ``rule``, which picks what holds."""
    sent = pc.is_null(group.column("id"))
    out = [group.filter(pc.invert(sent)).select(["found", "id"])]
    if blobs := group.filter(sent).column("found").to_pylist():
        keys, ids, pos = unpacked(blobs, widths)
        keep = rule(keys, ids, pos)
        found = list(by_id(ids[keep], pos[keep]))
        out.append(pa.table({"found": pa.array([f for _, f in found], pa.binary()), "id": pa.array([i for i, _ in found], pa.int64())}))
    return pa.concat_tables(out)


@lean
def _again(batches, parts: int, whole: tuple[int, ...], widths: tuple[int, ...]):
    """Deals the blobs of ranges, which come one range after another, to the parts of each."""
    blobs: list[bytes] = []

    def flush():
        if blobs:
            keys, ids, pos = unpacked(blobs, whole)
            own, row = np.unique(ids, return_inverse=True)
            order = np.argsort(row, kind="stable")
            yield from deal([k[order] for k in keys], widths, row[order], pos[order], own, parts)
            blobs.clear()

    at, size = None, 0
    for batch in batches:
        sent = pc.is_null(batch.column("id"))
        yield batch.filter(pc.invert(sent))
        some = batch.filter(sent)
        for part, found in zip(some.column("part").to_pylist(), some.column("found").to_pylist()):
            if part != at or size > BUFFER_BYTES:
                yield from flush()
                at, size = part, 0
            blobs.append(found)
            size += len(found)
    yield from flush()


def settle(rows: DataFrame, scan, parts: int, widths: tuple[int, ...], rule) -> DataFrame:
    """(id, list of packed places) of all windows of ``rows`` that ``rule`` picks; ``scan`` fills buffers."""
    ranges, each = parts, 1
    if parts > FAN:
        ranges, each = FAN, -(-parts // FAN)
    whole = (8,) * len(widths) if each > 1 else widths
    dealt = rows.mapInArrow(lambda b: scan(b, ranges, whole), DEALT)
    if each > 1:
        dealt = dealt.repartition("part").sortWithinPartitions("part").mapInArrow(lambda b: _again(b, ranges * each, whole, widths), DEALT)
    picked = dealt.groupBy("part").applyInArrow(lambda g: _settled(g, widths, rule), "found binary, id bigint")
    return picked.groupBy("id").agg(F.collect_list("found").alias("found"))


@lean
def _cut(batches):
    for batch in batches:
        out = [[], [], [], [], []]
        found = batch.column("found")
        for words in wh.slices(batch.column("text"), wh.KEEP, wh.SPACED):
            raw = words.data.tobytes()
            for r in range(words.rows):
                a, b = int(words.begins[r]), int(words.begins[r + 1])
                starts = np.unique(np.frombuffer(b"".join(found[words.first + r].as_py() or ()), "<u4").astype(np.int64))
                # of rows that share an id, a place may lie beyond this one's words
                starts = starts[starts + WINDOW <= b - a]
                cover = np.zeros(b - a + 1, np.int64)
                np.add.at(cover, starts, 1)
                np.add.at(cover, starts + WINDOW, -1)
                gone = np.cumsum(cover)[:-1] > 0
                edge = np.diff(gone.astype(np.int8), prepend=0, append=0)
                kept = a + np.flatnonzero(~gone)
                text = b" ".join([raw[s:e] for s, e in zip(words.starts[kept].tolist(), words.ends[kept].tolist())])
                out[0].append(b - a)
                out[1].append(int(gone.sum()))
                out[2].append([{"a": s, "b": e} for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())])
                out[3].append(hashlib.sha256(text).hexdigest())
                out[4].append(text.decode("utf-8"))
        spans = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        kinds = [pa.int64(), pa.int64(), spans, pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x, k) for x, k in zip(out, kinds))], ["id", "n_words", "n_removed", "removed", "kept_sha256", "kept_text"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_removed, removed (maximal spans of word places), kept_sha256 and
    kept_text (the kept words, joined by one space).

    Null and empty texts have no words. Rows without an id take no part and lose nothing. Ids are expected to
    be unique; rows that share one aren't compared with each other, and lose the same places. Other columns
    are not read. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "substring-dedup")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(LEAST_PARTS, -(-total // BUFFER_BYTES))
    valid = source.where("id is not null")
    anchors = scratch.save(settle(valid, _anchors, parts, (4,), _probe), "anchors")
    near = valid.join(anchors, "id").select("id", "text", "found")
    repeats = scratch.save(settle(near, _windows, parts, (8, 4), _extend), "repeats")
    scratch.drop("anchors")
    result = "id bigint, n_words bigint, n_removed bigint, removed array<struct<a:bigint,b:bigint>>, kept_sha256 string, kept_text string"
    return source.join(repeats, "id", "left").select("id", "text", "found").mapInArrow(_cut, result)
