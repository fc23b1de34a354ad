"""What operators keep in a Python worker between tasks.

Spark reuses workers, so a table that one operator keeps for its next task
would still fill memory while another operator runs. An operator claims the
worker when its task starts; what the others kept is then let go, and the
memory that their tasks freed, which allocators hold back, goes to the system.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_kept: dict[str, Callable[[], None]] = {}
_last: list[str] = []


def keep(name: str, release: Callable[[], None]) -> None:
    """Say how to let go of what ``name`` keeps."""
    _kept[name] = release


def claim(name: str) -> None:
    """Let go of all that other operators kept, and hand their memory back."""
    for other in [n for n in _kept if n != name]:
        _kept.pop(other)()
    if _last != [name]:
        _last[:] = [name]
        trim()


def trim() -> None:
    """Give freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)
