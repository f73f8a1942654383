"""Every operator as a query over the given tables, each with the SQL it must agree with."""

from . import aggregates, catalogs, joins, ordered, prediction, scalars, streams, views  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
