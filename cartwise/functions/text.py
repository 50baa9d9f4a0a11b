"""Text expressions (JVM-side, codegen'd).

Python's ``str.strip``, ``\\s``, ``\\w`` and ``\\b`` are Unicode-aware; Java regex
gets the same behaviour from the ``(?U)`` flag.  Spark's ``trim`` strips only
the space character, so stripping goes through a regex.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's: unit words folded to a short
# unit by basic normalization, as (pattern of alternatives, replacement).
UNIT_WORDS = [
    (r"inches|inch|in\.", "in"),
    (r"centimeters|centimetres|cm\.", "cm"),
    (r"grams|gram|g\.", "g"),
    (r"kilograms|kilogram|kg\.", "kg"),
]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Unicode whitespace strip at both ends (Python ``str.strip()``)."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def lower_strip(c) -> Column:
    """``str.strip().lower()``."""
    return F.lower(strip(c))


def normalize_basic(c) -> Column:
    """Null → '', strip, lower, collapse whitespace, fold unit words."""
    out = F.regexp_replace(lower_strip(F.coalesce(_c(c), F.lit(""))), r"(?U)\s+", " ")
    for words, unit in UNIT_WORDS:
        out = F.regexp_replace(out, rf"(?U)\b({words})\b", unit)
    return out


def tokens(c) -> Column:
    """Distinct whitespace tokens of the P06 form (``set(text.split())``)."""
    return F.array_distinct(F.filter(F.split(normalize_basic(c), " "), lambda t: t != ""))


def candidate_hash(items) -> Column:
    """sha256 of the sorted items joined with '|'."""
    return F.sha2(F.array_join(F.array_sort(_c(items)), "|"), 256)


def record_key(*cols) -> Column:
    """Fields rendered as text and joined with '|', missing → ''."""
    return F.concat_ws("|", *[F.coalesce(_c(c).cast("string"), F.lit("")) for c in cols])
