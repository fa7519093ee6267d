"""Every operator as a query over the given tables, with equivalent SQL where there is one."""

from loanlens.catalog import columns, features, io, modeling, quality, reporting  # noqa: F401
from loanlens.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
