"""Python workers give freed memory back to the system when a batch function or group is done.

Workers live for many tasks beside the executor's heap; what their allocators keep for later counts
against the same limit."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa

_trim: list = []


def tidy() -> None:
    pa.default_memory_pool().release_unused()
    if not _trim:
        try:
            _trim.append(ctypes.CDLL(None).malloc_trim)
        except (AttributeError, OSError):  # another C library
            _trim.append(lambda _: 0)
    _trim[0](0)


def tidy_batches(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    @wraps(f)
    def run(batches: Iterator) -> Iterator:
        yield from f(batches)
        tidy()

    return run


def tidy_groups(f: Callable) -> Callable:
    @wraps(f)
    def run(*tables: pa.Table) -> pa.Table:
        out = f(*tables)
        tidy()
        return out

    # Spark tells functions of a group from functions of a key and a group by their parameters.
    return {1: lambda table: run(table), 2: lambda left, right: run(left, right)}[f.__code__.co_argcount]
