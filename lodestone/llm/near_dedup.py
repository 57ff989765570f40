"""Near-duplicate detection with HyperMinHash sketches.

A document's set is its distinct five-word shingles. Each set has 280 registers: a shingle's hash picks the
register, and the smallest second hash in it is stored as its leading-zero count (5 bits) and the 7 bits after
the first one. For banding, an empty register borrows from the first filled one of its own sequence of others, so
that small sets have as many telling registers as large ones; registers of two sets agree with the probability of
their similarity either way. Five registers make a band; sets with an equal band are candidates. A link of
similarity 0.75 shares no band with probability 3e-7, and far less above the threshold.

Sets are collapsed first where they are equal, so that copies cost nothing further. Then components grow:

1. star: in each band's bucket, all members are compared with its head, the member that shares most buckets with
   others, such as the original of edited copies; each member is linked with the most similar of its heads.
2. best: buckets whose members still lie in several components are cut into blocks of bounded size, in which sketches
   meet. Each member is linked with the most similar member of another component.
3. all: what lies in several components still is compared in blocks once more, member by member.

Candidates are ruled out by their sizes and by the collision-corrected Jaccard estimate of their registers, inside
the block; only those that may be links leave it. Every comparison that counts is an exact one on full sets, so no
link between different components can be lost but by the banding and the estimate's stated error. A large bucket
costs comparisons inside blocks, but neither rows for its pairs nor a task that holds it whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import wordhash as wh
from lodestone.llm.scratch import Scratch
from lodestone.llm.worker import lean

SHINGLE = 5
BANDS, LANES = 56, 5
REGISTERS = BANDS * LANES
LZ_BITS, MANTISSA_BITS = 5, 7
LANE_BITS = LZ_BITS + MANTISSA_BITS
#: A link has 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Standard errors below the threshold at which an estimate rules a link out.
SIGMAS = 5
ROWS = 1024
#: Members of a bucket in a tile; a block holds one tile or two. Pairs whose sketches are compared at once.
TILE, AT_ONCE = 512, 2048
SKETCH = "id bigint, text_hash bigint, n bigint, d1 bigint, d2 bigint, bands array<bigint>, keys array<bigint>"
#: Registers that an empty one looks at, in turn.
TURNS = (wh.mix(np.arange(1, 256 * REGISTERS + 1, dtype=np.uint64)) % np.uint64(REGISTERS)).astype(np.int64).reshape(256, REGISTERS)

def shingle_sets(words: wh.Words) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; a row of fewer than five words is one shingle."""
    hashes = words.hashes()
    rolling = wh.grams(hashes, SHINGLE)
    out = []
    for a, b in zip(words.begins[:-1].tolist(), words.begins[1:].tolist()):
        if b - a >= SHINGLE:
            found = np.sort(rolling[a : b - SHINGLE + 1])
            out.append(found[np.concatenate([[True], found[1:] != found[:-1]])])
        else:
            out.append(wh.grams(hashes[a:b], b - a) if b > a else hashes[:0])
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """HyperMinHash registers: one row per set, 0 where no shingle fell."""
    sizes = np.array([len(s) for s in sets])
    shingles = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(sets)), sizes)
    place = ((shingles >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
    least = np.full(len(sets) * REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    value = wh.mix(shingles ^ np.uint64(0xA0761D6478BD642F))
    np.minimum.at(least, row * REGISTERS + place, value)
    filled = np.zeros(len(least), bool)
    filled[row * REGISTERS + place] = True
    zeros = np.minimum(64 - np.frexp(least.astype(np.float64))[1], (1 << LZ_BITS) - 2).clip(0)
    rest = (least << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA_BITS)
    out = np.where(filled, ((zeros + 1).astype(np.int64) << MANTISSA_BITS) | rest.astype(np.int64), 0)
    return out.reshape(len(sets), REGISTERS)


def filled(regs: np.ndarray) -> np.ndarray:
    """Registers of sets that aren't empty, with those that no shingle fell in filled from others. After all turns,
    which only the smallest sets need, the first that is filled is taken."""
    rows, out = regs.reshape(-1), regs.reshape(-1).copy()
    empty = np.flatnonzero(out == 0)
    for turn in TURNS:
        if not len(empty):
            break
        lane = empty % REGISTERS
        value = rows[empty - lane + turn[lane]]
        out[empty] = value
        empty = empty[value == 0]
    if len(empty):
        first = np.argmax(regs != 0, axis=1)
        row = empty // REGISTERS
        out[empty] = rows[row * REGISTERS + first[row]]
    return out.reshape(regs.shape)


def bands(regs: np.ndarray) -> np.ndarray:
    """Five registers to an integer of 60 bits."""
    lanes = regs.reshape(len(regs), BANDS, LANES)
    return (lanes << (LANE_BITS * np.arange(LANES))).sum(axis=2)


def lanes(packed: np.ndarray) -> np.ndarray:
    """The registers of packed bands, one row per set."""
    out = (packed.reshape(-1, BANDS, 1) >> (LANE_BITS * np.arange(LANES))) & ((1 << LANE_BITS) - 1)
    return out.astype(np.uint16).reshape(-1, REGISTERS)


def bucket_keys(regs: np.ndarray) -> np.ndarray:
    """A hash of each band and its place."""
    return wh.mix(bands(filled(regs)).astype(np.uint64) ^ wh.place_keys(BANDS)).view(np.int64)


@lean
def _sketch(batches):
    for batch in batches:
        for words in wh.slices(batch.column("text"), wh.FOLD, wh.SPACED):
            sets = shingle_sets(words)
            for a in range(0, words.rows, ROWS):
                part = sets[a : a + ROWS]
                sums = [wh.mix(s + np.uint64(1)) for s in part]
                regs = registers(part)
                some = np.array([len(s) > 0 for s in part])
                offsets = np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(words.first + a, len(part)),
                        batch.column("text_hash").slice(words.first + a, len(part)),
                        pa.array([len(s) for s in part], pa.int64()),
                        pa.array(np.array([s.sum(dtype=np.uint64) for s in sums], np.uint64).view(np.int64)),
                        pa.array(np.array([np.bitwise_xor.reduce(s) if len(s) else 0 for s in sums], np.uint64).view(np.int64)),
                        pa.FixedSizeListArray.from_arrays(pa.array(bands(regs).ravel()), BANDS).cast(pa.list_(pa.int64())),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(bucket_keys(regs[some]).ravel())),
                    ],
                    ["id", "text_hash", "n", "d1", "d2", "bands", "keys"],
                )


@lean
def _sets(batches):
    for batch in batches:
        for words in wh.slices(batch.column(1), wh.FOLD, wh.SPACED):
            sets = shingle_sets(words)
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            values = np.concatenate(sets).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(words.first, words.rows), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["id", "shingles"])


def estimates(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of sets with registers x and y and sizes nx and ny: the collision-corrected Jaccard estimate, and
    whether sizes and estimate allow a link.

    Registers in use hold one element of the union each, drawn without replacement, so that the share that agree has
    a hypergeometric error: none where every element has a register of its own. Besides the error's SIGMAS, one
    register is allowed for the correction, which is an average.
    """
    t = PERCENT / 100
    same, used = ((x == y) & (x != 0)).sum(axis=1), ((x | y) != 0).sum(axis=1)
    chance = 0.169919487159739 * 2.0**-MANTISSA_BITS * 4 * nx * ny / (nx + ny) ** 2
    j = (same / used - chance) / (1 - chance)
    unseen = np.clip(1 - used * (1 + t) / (nx + ny), 0, 1)
    error = np.sqrt(t * (1 - t) / used * unseen)
    return j, (100 * np.minimum(nx, ny) >= PERCENT * np.maximum(nx, ny)) & (j >= t - SIGMAS * error - 1 / used)


@lean
def _likely(batches):
    for batch in batches:
        for k in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(k, AT_ONCE)
            na, nb = (np.asarray(part.column(c)).astype(np.float64) for c in ("na", "nb"))
            j, keep = estimates(*(lanes(np.asarray(part.column(c).flatten())) for c in ("ba", "bb")), na, nb)
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(j)], ["a", "b", "j"]).filter(pa.array(keep))


def likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose sketches allow a link, with their estimate j."""
    one = sketches.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("bands").alias("ba"))
    two = sketches.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("bands").alias("bb"))
    met = pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "ba", "bb")
    return met.mapInArrow(_likely, "a bigint, b bigint, j double")


def in_blocks(block: np.ndarray):
    """Pairs of places of rows of the same block, for rows sorted by block, some at a time."""
    ends = np.searchsorted(block, block, "right")
    later = ends - np.arange(len(block)) - 1
    a = 0
    while a < len(block):
        # rows with about so many pairs together; a row has fewer than two tiles
        b = max(a + 1, int(np.searchsorted(np.cumsum(later[a:]), 1 << 18, "right")) + a)
        n = later[a:b]
        one = np.repeat(np.arange(a, b), n)
        yield one, one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(n) - n, n)
        a = b


def _met(rows: pa.Table, best: bool):
    """Of rows of whole blocks: pairs of different components that may be links; with ``best``, only the most similar
    one of each row. A pair that shares several buckets is looked at in the first of them alone."""
    block, key, id_, label, tile, n = (np.asarray(rows.column(c).combine_chunks()) for c in ("block", "key", "id", "label", "tile", "n"))
    two = np.asarray(rows.column("two").combine_chunks().cast(pa.int8())) > 0
    regs = lanes(np.asarray(rows.column("bands").combine_chunks().flatten()))
    keys = np.concatenate([bucket_keys(regs[k : k + ROWS].astype(np.int64)) for k in range(0, len(regs), ROWS)])
    earlier = np.arange(BANDS) < np.argmax(keys == key[:, None], axis=1)[:, None]
    size = n.astype(np.float64)
    found: list = [[], [], []]
    for a, b in in_blocks(block):
        few, many = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
        # a block of two tiles is for pairs between them
        open_ = (label[a] != label[b]) & (100 * few >= PERCENT * many) & ~(two[a] & (tile[a] == tile[b]))
        a, b = a[open_], b[open_]
        for k in range(0, len(a), AT_ONCE):
            x, y = a[k : k + AT_ONCE], b[k : k + AT_ONCE]
            here = ~((keys[x] == keys[y]) & earlier[x]).any(axis=1)
            x, y = x[here], y[here]
            j, keep = estimates(regs[x], regs[y], size[x], size[y])
            for column, value in zip(found, (x[keep], y[keep], j[keep])):
                column.append(value)
    a, b, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)
    if best:
        a, b, j = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([j, j])
        order = np.lexsort((id_[b], -j, id_[a]))
        first = np.ones(len(order), bool)
        first[1:] = id_[a[order[1:]]] != id_[a[order[:-1]]]
        a, b, j = a[order[first]], b[order[first]], j[order[first]]
    yield pa.RecordBatch.from_arrays([pa.array(id_[a], pa.int64()), pa.array(id_[b], pa.int64()), pa.array(j, pa.float64())], ["a", "b", "j"])


@lean
def _blocks(batches, best: bool):
    """Rows come sorted by block; the last block of a batch waits for the next one."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        block = np.asarray(batch.column("block"))
        if not len(block):
            continue
        last = int(np.searchsorted(block, block[-1]))
        if rest and rest[-1].column("block")[0].as_py() != block[0]:
            yield from _met(pa.Table.from_batches(rest), best)
            rest = []
        if last:
            yield from _met(pa.Table.from_batches([*rest, batch.slice(0, last)]), best)
            rest = []
        rest.append(batch.slice(last))
    if rest:
        yield from _met(pa.Table.from_batches(rest), best)


def across(member: DataFrame, found: DataFrame, sketch: DataFrame, best: bool) -> DataFrame:
    """Pairs (a, b) that may be links, of members of a bucket that lie in different components."""
    label = member.join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("label"))
    open_ = label.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count(F.lit(1)).alias("members")).where("least < most")
    tiles = F.ceil(F.col("members") / TILE).cast("int")
    rows = label.join(open_.select("key", tiles.alias("tiles")), "key").join(sketch, "id")
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    block = F.xxhash64("key", F.least("tile", "other"), F.greatest("tile", "other"))
    rows = rows.select(block.alias("block"), "key", "id", "label", "tile", (F.col("tile") != F.col("other")).alias("two"), "n", "bands")
    # both kinds of rows of a block of two tiles come: those of either tile
    pairs = rows.repartition("block").sortWithinPartitions("block").mapInArrow(lambda b: _blocks(b, best), "a bigint, b bigint, j double")
    return most_similar(pairs) if best else pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def most_similar(pairs: DataFrame) -> DataFrame:
    """Of each a's pairs, the one with the largest estimate."""
    mine = pairs.groupBy("a").agg(F.max_by("b", F.struct("j", -F.col("b"))).alias("b"))
    return mine.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose full sets are similar enough."""
    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    both = F.size("sa") + F.size("sb") - common
    return pairs.join(one, "a").join(two, "b").where(100 * common >= PERCENT * both).select("a", "b")


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, component) of all ids in links (a, b) but each component's smallest: alternating large and small
    stars until nothing changes. Each step takes minima per id before rows meet, and hubs are joined, not grouped."""
    edges = scratch.save(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), f"{name}-edges-0")
    mark, step = None, 0
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if now == mark or not now[0]:
            break
        mark, step = now, step + 1
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large, f"{name}-large-{step}")
        least = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("w")).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = scratch.save(small.where("u != v").distinct(), f"{name}-edges-{step}")
        scratch.drop(f"{name}-large-{step}", f"{name}-edges-{step - 1}")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Null and empty texts, and texts of white space, have no set, are linked with nothing and are kept, as are
    rows without an id. ``component_id`` is the smallest id that links reach. Rows with equal ids and texts get equal
    results; of rows that share an id but not their text, the one with the smallest hash of its text stands for all
    that have words. Other columns are not read. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "near-dedup")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketches = scratch.save(source.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_sketch, SKETCH), "sketches")
    linked = sketches.where("id is not null and n > 0")
    odd = linked.groupBy("id").agg(F.min("text_hash").alias("least"), F.max("text_hash").alias("most")).where("least != most").select("id", "least")
    odd = scratch.save(odd, "odd")
    if shared_ids := not odd.isEmpty():
        linked = linked.join(odd, "id", "left").where("least is null or text_hash = least").drop("least")
        source = source.join(odd, "id", "left").where(F.col("least").isNull() | (F.xxhash64("text") == F.col("least"))).drop("least")
    same = scratch.save(linked.groupBy("n", "d1", "d2").agg(F.min("id").alias("id")), "distinct")

    distinct = linked.select("id", "keys").join(same.select("id"), "id", "left_semi").dropDuplicates(["id"])
    band = scratch.save(distinct.select("id", F.explode("keys").alias("key")), "bands")
    shared = band.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    member = scratch.save(band.join(shared, "key"), "members")
    scratch.drop("bands")
    active = scratch.save(member.groupBy("id").agg(F.sum("members").alias("degree")), "active")
    sketch = scratch.save(linked.select("id", "n", "bands").join(active, "id", "left_semi").dropDuplicates(["id"]), "active-sketches")
    sets = source.join(active, "id", "left_semi").dropDuplicates(["id"])
    sets = scratch.save(sets.mapInArrow(_sets, "id bigint, shingles array<bigint>"), "sets")

    heads = member.join(active, "id").groupBy("key").agg(F.max_by("id", F.struct("degree", -F.col("id"))).alias("head"))
    met = member.join(heads, "key").where("id != head").select(F.col("id").alias("a"), F.col("head").alias("b")).distinct()
    pairs = scratch.save(most_similar(likely(met, sketch)), "pairs-star")
    links = scratch.save(verified(sets, pairs), "links-star")
    found = components(links, scratch, "star")
    for step, best in (("best", True), ("all", False)):
        pairs = scratch.save(across(member, found, sketch, best), f"pairs-{step}")
        links = scratch.save(verified(sets, pairs), f"links-{step}")
        if not links.isEmpty():
            found = components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(links), scratch, step)
    scratch.drop("members", "active-sketches", "sets")

    key = ["n", "d1", "d2"]
    named = same.join(found, "id", "left").select(*key, F.coalesce("component", "id").alias("component"))
    rows = sketches.select("id", *key)
    if shared_ids:
        of_ids = linked.select("id", *key).join(named, key).select("id", "component").distinct()
        rows = rows.join(of_ids, "id", "left").withColumn("component", F.when(F.col("n") > 0, F.col("component")))
    else:
        s, d = rows.alias("s"), named.alias("d")
        met = (F.col("s.n") == F.col("d.n")) & (F.col("s.d1") == F.col("d.d1")) & (F.col("s.d2") == F.col("d.d2")) & F.col("s.id").isNotNull()
        rows = s.join(d, met, "left").select("s.id", "s.n", "d.component")
    own = F.coalesce(F.col("component"), F.col("id"))
    return rows.select("id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"))
