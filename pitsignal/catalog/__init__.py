"""Every registered query, by name."""

from pitsignal.catalog import cleaning, diagnostics, explore, features, files, fuel, sections, shaping  # noqa: F401
from pitsignal.catalog.registry import QUERIES

__all__ = ["QUERIES"]
