"""Views, windowed reports and record jobs as registered queries."""

from . import range_queries as range_queries
from . import record_queries as record_queries
from . import relational_queries as relational_queries
from . import view_queries as view_queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
