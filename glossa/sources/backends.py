"""Recognition backends by name.

A backend is a callable that makes an engine of ``pdf.Backend``.  It is known by
the name it was registered under in this process, or by ``module:callable``,
which works from a shell as long as the executors can import the module.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from typing import Any

BACKENDS: dict[str, Callable[[], Any]] = {}


def register(name: str, make: Callable[[], Any]) -> None:
    """Make a backend known; a name that is taken is replaced."""
    BACKENDS[name] = make


def named(name: str) -> Callable[[], Any]:
    """The backend of a name; a name that says nothing is a ValueError."""
    if name in BACKENDS:
        return BACKENDS[name]
    module, _, attribute = name.partition(":")
    if not attribute:
        raise ValueError(f"unknown backend {name!r}; known: {', '.join(sorted(BACKENDS)) or 'none'}, or module:callable")
    try:
        found = getattr(importlib.import_module(module), attribute)
    except (ImportError, AttributeError) as e:
        raise ValueError(f"backend {name!r} can't be loaded: {e}") from e
    if not callable(found):
        raise ValueError(f"backend {name!r} is not callable")
    return found
