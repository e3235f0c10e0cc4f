"""All queries of the subpackage with their SQL."""

from __future__ import annotations

from . import abuse, language, mixing, overlap, packing, pii, sample, splits, subjects

_ALL = (language, sample, pii, overlap, splits, abuse, packing, mixing, subjects)
QUERIES = {k: v for m in _ALL for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _ALL for k, v in m.ORACLE.items()}
