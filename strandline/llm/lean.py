"""Python workers live on from task to task; these wrappers make them give memory back when a task or a large group ends."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa


def free() -> None:
    """Returns unused memory of Arrow's pool and of the C library to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def lean(run):
    """``run``, a function from batches to batches, freeing memory at its end."""

    def go(batches):
        try:
            yield from run(batches)
        finally:
            free()

    return go


def lean_group(run):
    """``run``, a function of whole groups, freeing memory after each."""

    def two(key, table):
        try:
            return run(key, table)
        finally:
            free()

    def three(key, a, b):
        try:
            return run(key, a, b)
        finally:
            free()

    return three if run.__code__.co_argcount == 3 else two
