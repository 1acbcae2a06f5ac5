"""All registered queries."""

from tallygrid.plans import cells, formats, grids, scoring, tables
from tallygrid.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "cells", "formats", "grids", "scoring", "tables"]
