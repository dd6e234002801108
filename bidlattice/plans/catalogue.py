"""All registered queries and their SQL twins, gathered from the plan modules."""

from __future__ import annotations

from . import extraction, kernel, lifecycle, matching, notices, publishing, records, retrieval, scalars  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
