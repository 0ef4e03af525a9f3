"""Python workers that give back what they no longer use."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa


def give_back() -> None:
    """Return memory that Arrow and malloc hold for reuse: several idle workers an executor keep it for a minute each."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


#: How to forget what a worker remembers between tasks, by the operator that has use for it.
_remembered: dict[str, Callable[[], None]] = {}


def remember(owner: str, forget: Callable[[], None]) -> None:
    """What ``forget`` drops stays in this worker until another operator's task begins in it."""
    _remembered[owner] = forget


def forget_others(owner: str) -> None:
    for name in [n for n in _remembered if n != owner]:
        _remembered.pop(name)()


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], owner: str = "") -> Callable:
    """The same Arrow function; its worker first forgets what other operators remember, and gives back spare memory when a task ends."""

    @wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(owner)
        try:
            yield from run(batches)
        finally:
            give_back()

    return inner
