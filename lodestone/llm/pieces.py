"""Distinct pieces of many texts, found by Arrow's hash tables instead of Python's."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BATCH_BYTES = 4 << 20


def batches(texts: pa.Array, most: int = BATCH_BYTES) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of about ``most`` bytes together, with the place of the first, null as empty; a longer one is
    alone. Only these are Python strings at a time."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    ends = np.cumsum(sizes)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] - sizes[a] + most, "right")))
        yield a, [t or "" for t in texts.slice(a, b - a).to_pylist()]
        a = b


#: A Latin letter and the punctuation after it: always of different pre-tokens.
BORDER = "([A-Za-zÀ-ÖØ-öø-ÿ])([.,!?;:|#%$&*])"


def split(texts: list[str], mark: str, before_spaces: bool = False) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts cut at each ``mark``, which is set between letters and punctuation first and, if asked for, before
    spaces and around line ends: the distinct pieces, the place of every piece among them, and the offsets
    of each text's pieces. An empty text is one empty piece."""
    column = pc.replace_substring_regex(pa.array(texts, pa.large_string()), BORDER, f"\\1{mark}\\2")
    if before_spaces:
        column = pc.replace_substring(column, " ", f"{mark} ")
        column = pc.replace_substring(column, "\n", f"{mark}\n{mark}")
    cut = pc.split_pattern(column, mark)
    coded = cut.values.dictionary_encode()
    return coded.dictionary.to_pylist(), np.asarray(coded.indices), np.asarray(cut.offsets).astype(np.int64)


def ragged(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """The runs ``values[starts[i] : starts[i] + sizes[i]]`` for each i of ``pick``, one after another."""
    size = sizes[pick]
    ends = np.cumsum(size)
    out = np.repeat(starts[pick] - ends + size, size)
    return values[out + np.arange(len(out))]
