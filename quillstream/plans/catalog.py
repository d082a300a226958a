"""Import every query module so the registry is complete."""

from . import dedup_queries, digest_queries, mail_queries, mutation_queries, normalize_queries, report_queries, runstate_queries, task_queries  # noqa: F401
from . import misc_queries  # noqa: F401,E402  (column views need the other modules registered first)
from .registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
