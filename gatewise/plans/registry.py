"""Name, query and SQL of every registered query of the core library."""

from . import edits, features, files, gating, images, plots, roundtrips, scalars, statistics, tables  # noqa: F401
from .common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
