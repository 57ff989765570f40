"""Token counts of a byte-level BPE by rank-synchronous merging of ragged arrays.

Texts are cut at single spaces, where no pre-token can cross. Pieces not seen before are pre-tokenised, and
all their distinct pre-tokens are merged together: symbols of every sequence lie in one numpy array, and in
each round every sequence applies its own lowest-rank pair wherever it occurs. What survives is counted.

A round costs a pass over what isn't finished, and a sequence takes as many as it applies ranks, so a pre-token of
thousands of bytes, such as encoded data without spaces, would cost its length many times over: those leave the array
and take their pairs from a heap, by rank and then by place, which is the same order.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.pieces import batches as batches_of
from lodestone.llm.pieces import split
from lodestone.llm.recall import Recall
from lodestone.llm.worker import lean

#: White space as the pre-tokeniser sees it, and its pattern.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^%s\p{L}\p{N}]+|[%s]+(?![^%s])|[%s]+"
#: A private-use character that cuts texts; one that holds it takes the slow way.
MARK = "\ue000"
#: Distinct pieces whose counts a generation of a Python worker's memory holds.
REMEMBERED = 600_000
BIG = np.iinfo(np.int32).max
#: Bytes of a pre-token from which on its pairs come from a heap.
LONG_RUN = 2048


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use: bytes that print stand for themselves, the
    others are counted up from 256."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merger:
    """The merge table of a tokenizers file: symbols are vocabulary ids, ranks are places in its list."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.byte_symbol = np.zeros(256, np.int64)
        for char, byte in byte_alphabet().items():
            self.byte_symbol[byte] = vocab[char]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.made = made
        self.scalar: dict[int, int] | None = None
        self.index(keys)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pattern = regex.compile(PRE_TOKEN % (SPACE, SPACE, SPACE, SPACE))
        self.seen = Recall(REMEMBERED)

    def index(self, keys: np.ndarray) -> None:
        """An open-addressing table of the pairs, at most a quarter full; empty places hold -1."""
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, BIG, np.int32)
        left = np.arange(len(keys))
        at = self.place(keys)
        while len(left):
            # of the pairs that meet at a free place the first gets it; the others go on to the next
            free = np.flatnonzero(self.keys[at] == -1)
            places, who = np.unique(at[free], return_index=True)
            got = free[who]
            self.keys[places], self.ranks[places] = keys[left[got]], left[got]
            rest = np.ones(len(left), bool)
            rest[got] = False
            left, at = left[rest], (at[rest] + 1) & self.mask

    def place(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = self.place(key)
        found = self.keys[at]
        out = np.where(found == key, self.ranks[at], BIG)
        open_ = np.flatnonzero((found != key) & (found != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found = self.keys[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    def lengths(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols that each byte sequence ends with."""
        sizes = np.array([len(t) for t in tokens], np.int64)
        out = np.zeros(len(tokens), np.int64)
        for i in np.flatnonzero(sizes >= LONG_RUN).tolist():
            out[i] = self.long_length(self.byte_symbol[np.frombuffer(tokens[i], np.uint8)])
        short = np.where(sizes < LONG_RUN, sizes, 0)
        symbols = self.byte_symbol[np.frombuffer(b"".join([t for t in tokens if len(t) < LONG_RUN]), np.uint8)]
        owner = np.repeat(np.arange(len(tokens)), short)
        while len(symbols):
            pair = np.full(len(symbols), BIG, np.int32)
            pair[:-1] = np.where(owner[:-1] == owner[1:], self.rank(symbols[:-1], symbols[1:]), BIG)
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            lowest = np.repeat(np.minimum.reduceat(pair, first), np.diff(np.append(first, len(symbols))))
            done = lowest == BIG
            if done.any():
                out += np.bincount(owner[done], minlength=len(out))
                symbols, owner, pair, lowest = symbols[~done], owner[~done], pair[~done], lowest[~done]
                if not len(symbols):
                    break
            merge = pair == lowest
            # equal symbols in a row: of overlapping pairs, every other one from the left is merged
            overlap = np.flatnonzero(merge[1:] & merge[:-1])
            if len(overlap):
                index = np.arange(len(merge))
                start = np.maximum.accumulate(np.where(merge & ~np.concatenate([[False], merge[:-1]]), index, -1))
                merge &= (index - start) % 2 == 0
            at = np.flatnonzero(merge)
            symbols[at] = self.made[pair[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return out

    def long_length(self, symbols: np.ndarray) -> int:
        """Symbols that one long sequence ends with."""
        if self.scalar is None:
            self.scalar = {k: r for k, r in zip(self.keys.tolist(), self.ranks.tolist()) if k >= 0}
        ranks, made = self.scalar, self.made
        rank = self.rank(symbols[:-1], symbols[1:]).astype(np.int64)
        at = np.flatnonzero(rank != BIG)
        heap = (rank[at] << 40 | at).tolist()
        heapify(heap)
        n = left = len(symbols)
        symbol, after, before = symbols.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            r, i = divmod(heappop(heap), 1 << 40)
            j = after[i]
            # a pair whose symbols have changed since is not there any more
            if symbol[i] < 0 or j >= n or ranks.get(symbol[i] << 32 | symbol[j]) != r:
                continue
            symbol[i], symbol[j], left = int(made[r]), -1, left - 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (new := ranks.get(symbol[i] << 32 | symbol[k])) is not None:
                    heappush(heap, new << 40 | i)
            if (p := before[i]) >= 0 and (new := ranks.get(symbol[p] << 32 | symbol[i])) is not None:
                heappush(heap, new << 40 | p)
        return left

    def learn(self, pieces: list[str]) -> None:
        """Counts of pieces not seen before; the special strings of the file are one token each."""
        whole, index = self.pattern.findall, {}
        cut = []
        for piece in pieces:
            n, parts = 0, [piece]
            if self.cut is not None and "<" in piece:
                n, parts = len(self.cut.findall(piece)), self.cut.split(piece)
            cut.append((n, [index.setdefault(t, len(index)) for part in parts for t in whole(part)]))
        counts = self.lengths([t.encode() for t in index]).tolist() if index else []
        self.seen.young.update((piece, n + sum([counts[t] for t in tokens])) for piece, (n, tokens) in zip(pieces, cut))

    def sizes(self, pieces: list[str]) -> np.ndarray:
        if new := self.seen.missing(set(pieces)):
            self.learn(new)
        known = self.seen.young
        return np.array([known[p] for p in pieces], np.int64)

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text. Where single spaces between words are the only ones, all texts are cut at once."""
        out = np.zeros(len(texts), np.int64)
        odd = [i for i, t in enumerate(texts) if not t or t[0] == " " or t[-1] == " " or MARK in t or "<" in t or ADJOINING.search(t)]
        even = np.setdiff1d(np.arange(len(texts)), odd)
        if len(even):
            distinct, at, offsets = split([texts[i] for i in even], MARK, before_spaces=True)
            out[even] = np.add.reduceat(self.sizes(distinct)[at], offsets[:-1])
        for i in odd:
            out[i] = self.sizes(pieces(texts[i])).sum()
        return out.tolist()


ADJOINING = re.compile(f"[{SPACE}][{SPACE}]")
LONE_SPACE = re.compile(f"(?<![{SPACE}]) (?![{SPACE}])")


def pieces(text: str) -> list[str]:
    """The text cut before each space that stands alone between others than white space; a pre-token takes
    at most such a space in front and none behind."""
    if len(text) < 3:
        return [text] if text else []
    # at the ends of the text a space has no neighbour and stays where it is
    head, *rest = LONE_SPACE.split(text[1:-1])
    parts = [text[0] + head, *(" " + p for p in rest)]
    parts[-1] += text[-1]
    return parts


@lru_cache(maxsize=4)
def merger(path: str) -> Merger:
    return Merger(path)


@lean
def _count(batches, path: str):
    counter = merger(path)
    for batch in batches:
        counts: list[int] = []
        sizes: list[int] = []
        for _, part in batches_of(batch.column(1)):
            counts += counter.count(part)
            sizes += [len(t.encode()) for t in part]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, for the byte-level BPE file at ``tokenizer``.

    Null text counts as empty (0 tokens). Ids may be null or repeat: rows are counted one by one. Special
    strings inside a text are one token, as the library does by default. Other columns are not read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(lambda batches: _count(batches, tokenizer), "id bigint, n_bytes bigint, n_tokens bigint")
