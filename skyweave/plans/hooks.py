"""Hook points: functions that others add, called in the order they were added.

``fold`` passes a value through all of a point's functions, ``ask`` takes the first answer that is not None.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

#: Points at which datasets and stacks are opened or shown, chosen from, sorted and dealt out.
POINTS = ("dataset_open", "dataset_instantiate", "lightcone_open", "lightcone_instantiate", "index_update", "post_sort", "partition")
_ADDED: dict[str, list[Callable]] = {p: [] for p in POINTS}


def add(point: str, func: Callable) -> Callable[[], None]:
    """Adds a function; what is returned takes it away again."""
    if point not in _ADDED:
        raise ValueError(f"hook point {point!r}: one of {', '.join(POINTS)}")
    _ADDED[point].append(func)
    return lambda: _ADDED[point].remove(func)


def fold(point: str, value: Any) -> Any:
    for f in _ADDED[point]:
        value = f(value)
    return value


def ask(point: str, *args: Any) -> Any:
    return next((a for f in _ADDED[point] if (a := f(*args)) is not None), None)
