"""User code by name: ``module:attribute`` of anything that can be imported."""

from __future__ import annotations

import importlib
from collections.abc import Callable


def plugin(name: str) -> Callable:
    """The callable that ``module:attribute`` names; anything else is an error that says what is wrong with it."""
    module, colon, attribute = name.partition(":")
    if not (module and colon and attribute):
        raise ValueError(f"unknown name: {name}")
    try:
        found = importlib.import_module(module)
        for part in attribute.split("."):
            found = getattr(found, part)
    except (ImportError, AttributeError) as e:
        raise ValueError(f"cannot load {name}: {e}") from e
    if not callable(found):
        raise ValueError(f"{name} cannot be called")
    return found
