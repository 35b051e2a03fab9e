"""Memory of Python workers, which outlive their tasks.

A worker that waits for its next task keeps what its allocators hold, beside the
Java heap of its executor and in the stages of other operators.
"""

from __future__ import annotations

import ctypes
from functools import cache

import pyarrow as pa


@cache
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


def freed() -> None:
    """Gives memory that nothing uses back to the system."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def returning(run):
    """The same function of a task's batches, which gives memory back at the end."""

    def batches(own):
        try:
            yield from run(own)
        finally:
            freed()

    return batches


def returning_group(run):
    """The same function of a group's table."""

    def group(table):
        try:
            return run(table)
        finally:
            freed()

    return group


def returning_groups(run):
    """The same function of the tables of a group of two sides."""

    def groups(left, right):
        try:
            return run(left, right)
        finally:
            freed()

    return groups
