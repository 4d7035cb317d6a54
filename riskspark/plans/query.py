"""A tiny decorator to name queries."""

from __future__ import annotations

from collections.abc import Callable


def register(into: dict[str, Callable], name: str) -> Callable:
    def wrap(fn: Callable) -> Callable:
        into[name] = fn
        return fn
    return wrap
