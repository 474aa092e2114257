"""What a Python worker keeps between tasks: one object at a time, of bounded size.

Spark reuses Python workers, so what one stage caches would stay beside what the next one does.
"""

from __future__ import annotations

import ctypes
import threading
from collections.abc import Callable

import pyarrow as pa

#: Bytes that a cache of words or chunks may take; beyond that it starts anew.
CACHE_BYTES = 96 << 20
#: Bytes that an entry takes beside its key's own: objects, their slots in tables, and a row of numbers.
ENTRY_BYTES = 160

_HELD: dict[object, object] = {}
_LOCK = threading.Lock()


def resident(key: object, make: Callable[[], object]) -> object:
    """The object under this key in this worker process; objects of other keys are dropped first."""
    with _LOCK:
        if key not in _HELD:
            _drop()
            _HELD[key] = make()
        return _HELD[key]


def release() -> None:
    """Drop what an earlier stage left in this worker process."""
    with _LOCK:
        _drop()


def _drop() -> None:
    """Drop what is held and give freed memory back to the system; allocators would keep it for this process."""
    _HELD.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no such function with other C libraries
        pass


class Places(dict):
    """Numbers keys in the order in which they are first asked for, and lists the new ones."""

    def __init__(self):
        self.new: list = []
        self.size = 0

    def __missing__(self, key) -> int:
        place = self[key] = len(self)
        self.new.append(key)
        self.size += len(key) + ENTRY_BYTES
        return place

    @property
    def full(self) -> bool:
        return self.size > CACHE_BYTES
