"""Every operator as a named query over the given tables, with its SQL twin."""

from .oracles import oracle_sql
from .queries import queries

__all__ = ["queries", "oracle_sql"]
