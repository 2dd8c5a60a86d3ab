"""Queries over the test tables, with their SQL."""

from . import billing, catalogue, registries, scopes  # noqa: F401  they register their queries
from .registered import oracle_sql, queries  # noqa: F401
