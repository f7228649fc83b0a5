"""Scalar functions on text, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the public pattern of protein accessions.
ACCESSION = r"(?i)^(?:[OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9](?:[A-Z][A-Z0-9]{2}[0-9]){1,2})$"
#: Fixed value: the letters a sequence may have (all but B and J).
RESIDUES = "AC-IK-Z"


def stripped(c: Column) -> Column:
    """Without white space at both ends; blank gives null."""
    t = F.btrim(c, F.lit(" \t\n\r\f\x0b"))
    return F.when(t != "", t)


def plain_id(c: Column) -> Column:
    """A trimmed id; a whole number that became a float is a whole number again. Blank gives null."""
    t = stripped(c)
    return F.when(t.endswith("0") & t.rlike(r"^[0-9]+\.0+$"), F.regexp_replace(t, r"\.0+$", "")).otherwise(t)


def id_number(c: Column) -> Column:
    """An id as a number for sorting, or null."""
    return F.when(c.rlike(r"^[0-9]{1,18}$"), c.try_cast("bigint"))


def positive_id(c: Column) -> Column:
    """A positive whole number from text, number or float text, else null."""
    n = stripped(c.cast("string")).try_cast("double")
    return F.when((n >= 1) & (n < 9.2e18), F.floor(n).cast("bigint"))


def clean_name(c: Column) -> Column:
    """Lower case, without parentheses and what follows a semicolon; null gives an empty text."""
    bare = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\(.*?\)", "")
    return F.trim(F.split(bare, ";")[0])


def _braced(value: Column) -> tuple[Column, Column]:
    """What stands before the first brace, and within it; both null unless the brace is closed."""
    parts = F.split(value, r"\{", 2)
    rest = F.get(parts, F.lit(1))
    closed = F.contains(rest, F.lit("}"))
    return F.when(closed, stripped(parts[0])), F.when(closed, F.substring_index(rest, "}", 1))


def kinetic_number(value: Column) -> Column:
    """The plain decimal number before a name in braces, or null."""
    head, _ = _braced(value)
    return F.when(head.rlike(r"^-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE]-?[0-9]+)?$"), head.try_cast("double"))


def kinetic_name(field: Column, value: Column) -> Column:
    """The name that a ligand field's item gives, or null: the one in braces after a number for fields of values, the whole text (unless `?`) for inhibitors; other fields give none."""
    _, inside = _braced(value)
    whole = F.nullif(stripped(value), F.lit("?"))
    return F.when(F.contains(field, F.lit("value")), F.when(kinetic_number(value).isNotNull(), stripped(inside))).when(F.contains(field, F.lit("inhibitor")), whole)


def affinity(c: Column) -> Column:
    """A number after `<` and `>` are taken away, else null."""
    return F.trim(F.regexp_replace(c, "[><]", "")).try_cast("double")


def valid_sequence(c: Column) -> Column:
    """Whether a text has only letters of residues, in whatever case, around white space; a blank text has, an empty or null one has not."""
    t = F.upper(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.coalesce((F.length(c) > 0) & t.rlike(f"^[{RESIDUES}]*$"), F.lit(False))


def first_part(c: Column, separator: str = r"\|") -> Column:
    return F.split(c, separator)[0]


def fasta_records(c: Column) -> Column:
    """(accession, sequence) of every record of a FASTA text."""
    records = F.filter(F.split(c, "(?m)^>"), lambda r: F.trim(r) != "")
    lines = lambda r: F.split(r, r"\r?\n")
    return F.transform(records, lambda r: F.struct(F.coalesce(F.nullif(F.regexp_extract(lines(r)[0], r"^\w+\|([^|]+)\|", 1), F.lit("")), F.regexp_extract(lines(r)[0], r"^(\S+)", 1)).alias("accession"), F.array_join(F.transform(F.slice(lines(r), 2, 1 << 30), lambda x: F.trim(x)), "").alias("sequence")))
