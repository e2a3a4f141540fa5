"""The registered queries."""

from . import finding_queries, graph_queries, record_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
