"""Registered queries and their SQL forms."""

import importlib
import pkgutil


def load_all() -> None:
    """Import every query module of this package."""
    for m in sorted(x.name for x in pkgutil.iter_modules(__path__) if x.name.startswith("q_")):
        importlib.import_module(f"checks.{m}")
