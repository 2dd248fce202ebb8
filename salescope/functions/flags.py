"""Parsing of yes/no style flags from raw text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings (compared case-insensitively, trimmed).
TRUE_TOKENS = ("true", "yes", "y", "1", "t")
FALSE_TOKENS = ("false", "no", "n", "0", "f", "unknown", "")


def parse_flag(c: Column, default: bool = False) -> Column:
    """Boolean from a boolean or text column; unknown spellings give ``default``."""
    s = F.lower(F.trim(c.cast("string")))
    return (F.when(s.isin(*TRUE_TOKENS), True)
             .when(s.isin(*FALSE_TOKENS), False)
             .otherwise(F.lit(default)))
