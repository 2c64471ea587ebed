"""State that outlives a task in a Python worker.

The package travels with each job, so its module globals are new in every task; what is costly to
build, and the same for all tasks, is kept in a module of its own in the worker's process.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from typing import Any

import pyarrow as pa

_HOLDER = "_ledgerlint_worker_state"


def kept(kind: str, key: Any, build: Callable[[], Any]) -> Any:
    """``build()``, or what it gave before for this kind and key. A worker holds one thing at a time:
    asking for another lets the former go."""
    held = sys.modules.setdefault(_HOLDER, types.ModuleType(_HOLDER)).__dict__
    found = held.get("held")
    if found is None or found[0] != (kind, key):
        held["held"] = None
        found = held["held"] = ((kind, key), build())
    return found[1]


def release() -> None:
    """Let go what an earlier task's operator kept, and the memory Arrow holds free; operators that
    keep nothing begin with it."""
    module = sys.modules.get(_HOLDER)
    if module is not None:
        module.__dict__["held"] = None
    pa.default_memory_pool().release_unused()
