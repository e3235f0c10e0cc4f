"""Normal forms of keys: the same thing is the same string however it was written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts and authors that stand for something taken away.
SENTINELS = ("[removed]", "[deleted]")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bare_id(c: Column | str) -> Column:
    """Id without blanks and type prefix; null where nothing is left."""
    return F.nullif(F.regexp_replace(F.trim(_col(c).cast("string")), r"^t[0-9]_", ""), F.lit(""))


def community_key(c: Column | str) -> Column:
    """Community name in lower case without blanks and leading r/; null where nothing is left."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(_col(c))), r"^/?r/", ""), F.lit(""))


def author_key(c: Column | str) -> Column:
    """Author name in lower case without leading u/; null for sentinels and blanks."""
    a = F.regexp_replace(F.lower(F.trim(_col(c))), r"^/?u/", "")
    return F.when((a != "") & ~a.isin(*SENTINELS), a)


def has_text(c: Column | str) -> Column:
    """True for a text that is neither null, blank nor a sentinel."""
    t = F.trim(_col(c))
    return F.coalesce((t != "") & ~t.isin(*SENTINELS), F.lit(False))
