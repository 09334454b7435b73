"""Comparison keys built from expressions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind, as a Java character class body.
SPACE = r"\s\p{Z}\x1c-\x1f\x85"


def trimmed(c: Column | str) -> Column:
    """The text without outer white space of any kind; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def slug_key(c: Column | str) -> Column:
    """Trimmed and in lower case; blank counts as null."""
    k = F.lower(trimmed(c))
    return F.when(k != "", k)
