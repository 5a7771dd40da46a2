"""Operators on lattices, each registered under its command-line name."""

from __future__ import annotations

from collections.abc import Callable

REGISTRY: dict[str, Callable] = {}


def operator(*names: str):
    """Register a function ``(lattice, *args) -> lattice``."""

    def add(f):
        for n in names:
            REGISTRY[n] = f
        return f

    return add


from gridloom.operators import components, geometry, lines, pointwise, reduce, register, stencil, temporal, tensor  # noqa: E402, F401
