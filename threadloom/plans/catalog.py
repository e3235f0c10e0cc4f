"""All queries of the core with their SQL."""

from __future__ import annotations

from . import operators, relational, reply_trees

_ALL = (reply_trees, operators, relational)
QUERIES = {k: v for m in _ALL for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _ALL for k, v in m.ORACLE.items()}
