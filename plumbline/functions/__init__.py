"""Scalar and list functions, by family; `lookup` finds one by its name in the query language."""

from __future__ import annotations

import re
from collections.abc import Callable
from importlib import import_module

FAMILIES = ("nulls", "strings", "maths", "dates", "collections", "variant", "hashing")


def python_name(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", name).lower()


def lookup(name: str, family: str | None = None) -> Callable:
    """lookup("jaroWinklerSimilarity"); a family tells functions of one name apart, as `max` of numbers and of lists."""
    for where in (family,) if family else FAMILIES:
        module = import_module(f"plumbline.functions.{where}")
        for spelled in (python_name(name), python_name(name) + "_"):
            if callable(found := getattr(module, spelled, None)) and getattr(found, "__module__", "").startswith("plumbline"):
                return found
    raise KeyError(name)
