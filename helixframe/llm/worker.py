"""What a Python worker keeps between tasks.

Workers are reused by later stages, so what one operator keeps would count
against the memory of the next; it goes as soon as another operator runs.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc

import pyarrow as pa

_kept: dict[tuple, object] = {}


def enter(owner: str) -> None:
    """Called where an operator's function begins in a worker: drops what other operators have kept."""
    if others := [k for k in _kept if k[0] != owner]:
        for k in others:
            del _kept[k]
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # another libc keeps what it has
            ctypes.CDLL(None).malloc_trim(0)


def keep(owner: str, name: str, make):
    """The operator's kept object of that name, made if there is none."""
    if (owner, name) not in _kept:
        _kept[owner, name] = make()
    return _kept[owner, name]
