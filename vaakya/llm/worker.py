"""What a Python worker keeps from one task to the next."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Hashable
from typing import Any

from pyspark import cloudpickle


def once(kind: str, key: Hashable, make: Callable[[], Any]) -> Any:
    """``make()`` of the first task of this process that asks for ``key``; one value of a kind is kept, the last.

    Functions travel to workers by value, so what their modules hold is new in each task; a
    module of the process itself outlives them.
    """
    kept = sys.modules.setdefault("_vaakya_kept", types.ModuleType("_vaakya_kept")).__dict__
    if kept.get(kind, (None,))[0] != key:
        kept.pop(kind, None)  # the old value goes before the new one is made
        kept[kind] = key, make()
    return kept[kind][1]


cloudpickle.register_pickle_by_value(sys.modules[__name__])
