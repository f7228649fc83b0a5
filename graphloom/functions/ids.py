"""Comparable forms of dirty identifiers, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def alnum_key(c: Column) -> Column:
    """Letters and digits in upper case; null where none is left."""
    return F.nullif(F.upper(F.regexp_replace(c, r"[^\p{L}\p{Nd}]+", "")), F.lit(""))


def entity_key(c: Column) -> Column:
    """Letters and digits of an id in upper case; the `.0` of an id that became a float is dropped if all else are digits.

    Null, empty and blank ids, and ids without a letter or digit, give null.
    """
    bare = F.regexp_replace(c, r"[^\p{L}\p{Nd}.]+", "")
    whole = F.regexp_replace(bare, r"^([\p{Nd}.]*\p{Nd})\.0\.*$", "$1")
    return F.nullif(F.upper(F.replace(whole, F.lit("."), F.lit(""))), F.lit(""))
