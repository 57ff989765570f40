"""What Python workers do besides their work. They are reused, and keep what a task has freed unless told otherwise."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa


def give_back() -> None:
    """Returns freed memory to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def lean(work: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A generator over a task's batches that gives back at its end what it has freed."""

    @functools.wraps(work)
    def run(*args, **kwargs):
        yield from work(*args, **kwargs)
        give_back()

    return run
