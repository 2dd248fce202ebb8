"""Text and number formatting as Catalyst expressions (no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python-style title case: a capital after any non-letter, the rest lower
# ("e-wallet o'brien" -> "E-Wallet O'Brien"); Spark's initcap only splits on
# spaces.  Runs of letters / non-letters are cased separately.
_TOKENS = r"(\p{L}+|[^\p{L}]+)"
# Printable ASCII whose letters follow a letter, a space or nothing: there
# initcap gives the same.
_PLAIN = r"^(?:[A-Za-z ]++|[!-@\[-`{-~]++(?![A-Za-z]))*+\z"
_SPACES = " \t\n\x0b\f\r"


def title_case(c: Column) -> Column:
    runs = F.transform(F.regexp_extract_all(c, F.lit(_TOKENS), 1), lambda t: F.initcap(t))
    return F.when(c.rlike(_PLAIN), F.initcap(c)).otherwise(F.array_join(runs, ""))


def strip_all(c: Column) -> Column:
    """Remove leading/trailing whitespace of every kind (not only spaces)."""
    return F.trim(c, F.lit(_SPACES))


def feature_display_name(feature: Column, source: Column | None = None,
                         level: Column | None = None) -> Column:
    """Readable name of a model feature.

    ``store_rating`` -> ``Store Rating``; a name with two or more underscores
    is split at the last one: ``payment_mode_Card`` -> ``Payment Mode = Card``.
    When one-hot metadata (source column, level) is given and the level
    itself contains ``_``, the split uses the metadata instead, so
    ``payment_mode`` / ``Credit_Card`` prints ``Payment Mode = Credit Card``.
    """
    plain = title_case(F.translate(feature, "_", " "))
    head = F.regexp_extract(feature, r"^(.*)_([^_]*)$", 1)
    tail = F.regexp_extract(feature, r"^(.*)_([^_]*)$", 2)
    split = F.concat(title_case(F.translate(head, "_", " ")), F.lit(" = "), title_case(tail))
    name = F.when(F.regexp_count(feature, F.lit("_")) > 1, split).otherwise(plain)
    if source is not None and level is not None:
        meta = F.concat(title_case(F.translate(source, "_", " ")), F.lit(" = "),
                        title_case(F.translate(level, "_", " ")))
        name = F.when(level.isNotNull() & level.contains("_"), meta).otherwise(name)
    return name


def money(c: Column, digits: int = 2) -> Column:
    """``$1,234.57``."""
    return F.concat(F.lit("$"), F.format_number(c, digits))


def compact_number(c: Column) -> Column:
    """1.2K / 3.4M for KPI tiles; smaller values with thousands separators."""
    return (F.when(c >= 1_000_000, F.concat(F.format_number(c / 1_000_000, 1), F.lit("M")))
             .when(c >= 1_000, F.concat(F.format_number(c / 1_000, 1), F.lit("K")))
             .otherwise(F.format_number(c, 0)))


def table_number(c: Column) -> Column:
    """Table cells: ``$`` and no decimals from 1,000 up, else up to 2 decimals."""
    return (F.when(c >= 1000, F.concat(F.lit("$"), F.format_number(c, 0)))
             .otherwise(F.regexp_replace(F.format_number(c, 2), r"\.?0+$", "")))


def long_date(c: Column) -> Column:
    """``Jan 05, 2024``."""
    return F.date_format(c, "MMM dd, yyyy")
