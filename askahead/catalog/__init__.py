"""Every operator as a query over the given tables."""

from askahead.catalog import codes, evaluation, labelling, sequences, tables  # noqa: F401
from askahead.catalog.base import QUERIES
from askahead.catalog.base import SQL as ORACLES

__all__ = ["ORACLES", "QUERIES"]
