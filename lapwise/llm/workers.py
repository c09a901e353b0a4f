"""What a Python worker keeps between tasks: one tool at a time, so that its memory goes to the next operator's tasks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from typing import Any

import pyarrow as pa

from lapwise.llm import textblocks as tb

_HELD: dict[str, Any] = {}


def held(name: str, make: Callable[[], Any]) -> Any:
    """The tool of that name, made where the worker does not hold it."""
    if name not in _HELD:
        release()
        _HELD[name] = make()
    return _HELD[name]


def release() -> None:
    """Lets go of the tool that the worker holds, and of memory that earlier tasks have freed."""
    for tool in _HELD.values():
        tool.close()
    _HELD.clear()
    tb.forget_powers()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # the C library keeps what is freed otherwise
        trim(0)
