"""What Python workers keep between tasks: bounded memos, and giving memory back.

A worker process serves many tasks and operators. Memos are bounded; when another
operator starts in the process the memos of the last one are dropped.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_OWNER: list[str] = [""]
_CLEAR: dict[str, Callable[[], None]] = {}


class Memo(dict):
    """A bounded memo of a function: two generations, so that what is used often stays."""

    def __init__(self, fill: Callable, limit: int):
        super().__init__()
        self.fill, self.limit, self.old = fill, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.fill(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

    def drop(self) -> None:
        self.clear()
        self.old = {}


def enter(operator: str, clear: Callable[[], None]) -> None:
    """To be called at the start of a task."""
    _CLEAR[operator] = clear
    if _OWNER[0] != operator:
        for name, drop in _CLEAR.items():
            if name != operator:
                drop()
        if _OWNER[0]:
            settle()
        _OWNER[0] = operator


def settle() -> None:
    """Gives freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass
