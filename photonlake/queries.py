"""All of the library's own queries and the SQL that checks them."""

from __future__ import annotations

from photonlake.jobs import datasets, intervals, lightcurves, maps, reduction, selections, statistics  # noqa: F401
from photonlake.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
