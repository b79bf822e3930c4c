"""Caches that live in a Python worker between tasks. A worker holds those of one operator at a time."""

from __future__ import annotations

from collections.abc import Callable

_owners: dict[str, Callable[[], None]] = {}


def owner(name: str, clear: Callable[[], None]) -> None:
    """Register an operator's caches by the function that empties them."""
    _owners[name] = clear


def only(name: str) -> None:
    """Empty all caches but those of one operator; called where a task of it begins."""
    for other, clear in _owners.items():
        if other != name:
            clear()
