"""Named queries over the test tables, each with its independent SQL form."""

from __future__ import annotations

import importlib

MODULES = [
    "metric_core", "units_groups", "screening", "ordering", "resampling", "governance", "reporting", "tables", "modelling",
]


def load() -> None:
    """Import every query module so that its queries register."""
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
