"""Python workers outlive their tasks; what a task no longer needs is given back at its end."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _TRIM = None


def hand_back() -> None:
    """Free Arrow's unused memory and the allocator's empty pages."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def tidy(function: Callable[..., Iterator], *after: Callable[[], None]) -> Callable[..., Iterator]:
    """``function``, a task's generator, with ``after`` and :func:`hand_back` at its end, however it ends."""

    def run(*arguments):
        try:
            yield from function(*arguments)
        finally:
            for step in after:
                step()
            hand_back()

    return run
