"""Quantities recorded in different units, brought to one unit.

Conversions are edges of a graph of units. Each edge is an affine function of a unit's coordinate: log10 of the value for units of
concentration, the value itself for logarithmic scales; so `-log M` joins the graph by a slope of -1. The shortest composition from every
unit to every other is computed once on the driver (the graph has as many nodes as there are units), cycles are checked for
consistency, and values meet their conversion in an equi-join on (unit, canonical unit).

Which unit a value has is read off text: a unit written with the value holds before one stated in the row's note, that before one
stated by the depositor or dataset, else nM.
"""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CANONICAL = "nM"


@dataclass(frozen=True)
class Conversion:
    """coordinate(target) = slope * coordinate(source) + shift"""

    source: str
    target: str
    slope: float
    shift: float


#: Units whose coordinate is the value itself; those of all others are log10 of the value.
LOGARITHMIC = frozenset({"-log M"})
#: What each unit is of the next.
CONVERSIONS = (
    Conversion("M", "mM", 1, 3),
    Conversion("mM", "uM", 1, 3),
    Conversion("uM", "nM", 1, 3),
    Conversion("nM", "pM", 1, 3),
    Conversion("M", "nM", 1, 9),
    Conversion("-log M", "M", -1, 0),
)


def compositions(conversions: tuple[Conversion, ...] = CONVERSIONS) -> dict[tuple[str, str], tuple[float, float, int]]:
    """(slope, shift, steps) of the shortest composition between any two units that are connected.

    Raises ValueError if two ways between the same units disagree (an inconsistent cycle) or a slope is 0.
    """
    links: dict[str, list[tuple[str, float, float]]] = {}
    for c in conversions:
        if c.slope == 0:
            raise ValueError(f"{c.source} to {c.target} can't be inverted")
        links.setdefault(c.source, []).append((c.target, c.slope, c.shift))
        links.setdefault(c.target, []).append((c.source, 1 / c.slope, -c.shift / c.slope))
    out = {}
    for start in links:
        seen = {start: (1.0, 0.0, 0)}
        queue = deque([start])
        while queue:
            unit = queue.popleft()
            a, b, n = seen[unit]
            for to, slope, shift in links[unit]:
                there = (slope * a, slope * b + shift, n + 1)
                if to not in seen:
                    seen[to] = there
                    queue.append(to)
                elif not (math.isclose(seen[to][0], there[0], rel_tol=1e-9) and math.isclose(seen[to][1], there[1], rel_tol=1e-9, abs_tol=1e-9)):
                    raise ValueError(f"two ways from {start} to {to} disagree: {seen[to][:2]} and {there[:2]}")
        out |= {(start, to): v for to, v in seen.items()}
    return out


def conversion_table(spark: SparkSession, conversions: tuple[Conversion, ...] = CONVERSIONS) -> DataFrame:
    """`unit_name`, `to_unit`, `slope`, `shift`, `logs_in`, `logs_out`: a row for each connected pair of units."""
    rows = [(u, v, a, b, u in LOGARITHMIC, v in LOGARITHMIC) for (u, v), (a, b, _) in compositions(conversions).items()]
    return spark.createDataFrame(rows, "unit_name string, to_unit string, slope double, shift double, logs_in boolean, logs_out boolean")


# Words for units in texts: fixed values.
_PER_LITRE = r"\s*(?:/\s*l(?:it(?:re|er)s?)?|per\s+l(?:it(?:re|er))?|l\s*(?:\^?\s*[-−–]\s*1|⁻¹))"
_UNIT = rf"(?:(pico|nano|micro|milli)?molar|([pnuµμm])?mol(?:es?)?{_PER_LITRE}|([pnuµμm])m|m)"
_NUMBER = r"(?:\d[\d.,']*(?:e[+-]?\d+)?|\.\d+)"
_POWER = r"(?:\s*[x×*·]\s*10\s*\^?\s*[-−–+]?\d+)"
#: In a note a bare `m` counts only in upper case, and a unit after a number tells an amount of something else.
_NOTE_UNIT = rf"(?<![\p{{L}}\p{{N}}])(?:(?i:(pico|nano|micro|milli)?molar|([pnuµμm])?mol(?:es?)?{_PER_LITRE})|([pnuµμm])[mM]|M)(?![\p{{L}}\p{{N}}])"
_AMOUNT = rf"(?<![\p{{L}}\p{{N}}.,])\d[\d.,]*\s*(?:(?i:(?:pico|nano|micro|milli)?molar|[pnuµμm]?mol(?:es?)?{_PER_LITRE})|[pnuµμm][mM]|M)(?![\p{{L}}\p{{N}}])"
_LOG_NOTE = r"(?i)neg(?:ative|\.)?\s+(?:decadic\s+)?log|[-−–]\s*log|\blogarithmic\b|(?<![\p{L}\p{N}])p(?:x|ki|kd|km|ic\s?50|ec\s?50)(?![\p{L}\p{N}])"
#: Phrasings by which a note speaks of one field only; a bounded list, any other note speaks of all fields.
_FIELD = r"(?i)(?<![\p{L}\p{N}])(ki|kd|ic\s?50)\s+(?:is\s+in|column\s+in|values?\s+in|only\s*:)"
_NO_CONCENTRATION = r"(?i)\bno (?:concentration|unit)|\bdimensionless\b|\bconfidence\b"


def _named(prefix: Column) -> Column:
    p = F.lower(prefix)
    return F.when(p.isin("p", "pico"), "pM").when(p.isin("n", "nano"), "nM").when(p.isin("u", "µ", "μ", "micro"), "uM").when(p.isin("m", "milli"), "mM").otherwise("M")


def _prefix(text: Column, pattern: str) -> Column:
    found = [F.regexp_extract(text, pattern, i) for i in (1, 2, 3)]
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in found), F.lit(""))


def note_unit(note: Column) -> Column:
    """The unit a note states for recorded values, or null.

    Amounts of other things (a number and a unit, as in `stock 10 mM`) do not count. A note that names a logarithm states `-log M`.
    """
    rest = F.regexp_replace(note, _AMOUNT, " ")
    return F.when(note.rlike(_LOG_NOTE), "-log M").when(rest.rlike(_NOTE_UNIT), _named(_prefix(F.regexp_extract(rest, _NOTE_UNIT, 0), _NOTE_UNIT)))


def note_field(note: Column) -> Column:
    """The one field (`ki`, `kd`, `ic50`) a note speaks of, or null if it speaks of all."""
    return F.nullif(F.replace(F.lower(F.regexp_extract(note, _FIELD, 1)), F.lit(" "), F.lit("")), F.lit(""))


_VALUE = rf"(?i)^[\s<>=~≤≥≈]*(?:p\s?(?:ki|kd|km|ic\s?50)\s*[:=]?\s*)?[<>=~≤≥≈\s]*({_NUMBER}{_POWER}?)\s*(?:(?:±|\+/-)\s*{_NUMBER}{_POWER}?)?\s*[(\[]?\s*({_UNIT})?\s*[)\]]?\s*$"
_LOG_VALUE = r"(?i)^[\s<>=~≤≥≈]*p\s?(?:ki|kd|km|ic\s?50)\b"


def _plain(text: Column) -> Column:
    return F.regexp_replace(text, r"[\s   ]+", " ")


def value_unit(text: Column) -> Column:
    """The unit written with a value, or null."""
    t = _plain(text)
    unit = F.regexp_extract(t, _VALUE, 2)
    return F.when(t.rlike(_LOG_VALUE), "-log M").when(unit != "", _named(_prefix(unit, rf"(?i)^{_UNIT}$")))


def value_number(text: Column) -> Column:
    """The number of a value as double, or null: `83,600` has a comma every three digits, `0,5` a decimal comma, `4.1 x 10^-7` a power, and what follows ± is left out."""
    raw = F.lower(F.regexp_extract(_plain(text), _VALUE, 1))
    mantissa = F.regexp_extract(raw, rf"^({_NUMBER})", 1)
    power = F.regexp_replace(F.regexp_extract(raw, r"[x×*·]\s*10\s*\^?\s*([-−–+]?\d+)$", 1), "[−–]", "-")
    mantissa = (
        F.when(mantissa.rlike(r"^[1-9]\d{0,2}(?:,\d{3})+(?:\.\d*)?(?:e[+-]?\d+)?$"), F.replace(mantissa, F.lit(","), F.lit("")))
        .when(mantissa.rlike(r"^[1-9]\d{0,2}(?:'\d{3})+(?:\.\d*)?(?:e[+-]?\d+)?$"), F.replace(mantissa, F.lit("'"), F.lit("")))
        .otherwise(F.replace(mantissa, F.lit(","), F.lit(".")))
    )
    return F.when(mantissa == "", None).otherwise(mantissa.try_cast("double") * F.pow(F.lit(10.0), F.coalesce(power.try_cast("int"), F.lit(0))))


def depositor_values(bindingdb: DataFrame, depositor: DataFrame) -> DataFrame:
    """`source_table`, `record_id`, `field_name`, `value_text`, `number`, `unit_name` of every value that has a number."""
    # A depositor with several notes has the unit of the first of them, by text, that states one.
    who = depositor.select(F.col("depositor_id").alias("who"), "practice_note", note_unit(F.col("practice_note")).alias("who_unit")).where("who_unit is not null")
    who = who.groupBy("who").agg(F.min(F.struct("practice_note", "who_unit")).getField("who_unit").alias("who_unit"))
    rows = bindingdb.select("entry_id", "depositor_id", "curator_note", "ki", "kd", "ic50")
    rows = rows.select("entry_id", "depositor_id", note_unit(F.col("curator_note")).alias("row_unit"), note_field(F.col("curator_note")).alias("row_field"), F.expr("stack(3, 'ki', ki, 'kd', kd, 'ic50', ic50) as (field_name, value_text)"))
    rows = rows.where("value_text is not null").withColumn("number", value_number(F.col("value_text"))).where("number is not null")
    rows = rows.join(who, F.col("depositor_id") == F.col("who"), "left")
    row_unit = F.when(F.col("row_field").isNull() | (F.col("row_field") == F.col("field_name")), F.col("row_unit"))
    unit = F.coalesce(value_unit(F.col("value_text")), row_unit, F.col("who_unit"), F.lit(CANONICAL))
    return rows.select(F.lit("bindingdb").alias("source_table"), F.col("entry_id").cast("bigint").alias("record_id"), "field_name", "value_text", "number", unit.alias("unit_name"))


def score_values(edges: DataFrame, notes: DataFrame) -> DataFrame:
    """The same of raw_score. Scores of a dataset without concentrations are left out; of datasets joined with `|` whose units differ, the first that states one holds."""
    # A note table has a row for each dataset; its units become one small map, so that joined names need no join of their own.
    name = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    told = notes.select(name(F.col("source_dataset")).alias("set"), "unit_note", F.when(F.col("unit_note").rlike(_NO_CONCENTRATION), "none").otherwise(note_unit(F.col("unit_note"))).alias("set_unit"))
    told = told.where("set is not null and set_unit is not null").groupBy("set").agg(F.min(F.struct("unit_note", "set_unit")).getField("set_unit").alias("set_unit"))  # of several notes, the first by text
    rows = edges.select("interaction_id", "raw_score", "source_dataset", "score_note").where(F.col("raw_score").isNotNull() & ~F.isnan("raw_score"))
    named = edges.select("source_dataset").where("source_dataset is not null").distinct()  # a row for each spelling
    parts = named.select("source_dataset", F.posexplode(F.split("source_dataset", r"\|")).alias("i", "part"))
    of_set = parts.join(told, name(F.col("part")) == F.col("set")).groupBy("source_dataset").agg(F.min(F.struct("i", "set_unit")).getField("set_unit").alias("set_unit"))
    rows = rows.join(of_set.select(F.col("source_dataset").alias("spelt"), "set_unit"), F.col("source_dataset") == F.col("spelt"), "left")
    unit = F.coalesce(note_unit(F.col("score_note")), F.col("set_unit"), F.lit(CANONICAL))
    rows = rows.where(F.coalesce(F.col("set_unit"), F.lit("")) != "none")
    return rows.select(F.lit("canonical_interaction").alias("source_table"), F.col("interaction_id").cast("bigint").alias("record_id"), F.lit("raw_score").alias("field_name"), F.col("raw_score").cast("string").alias("value_text"), F.col("raw_score").alias("number"), unit.alias("unit_name"))


def quantities(bindingdb: DataFrame, depositor: DataFrame, edges: DataFrame, notes: DataFrame) -> DataFrame:
    return depositor_values(bindingdb, depositor).unionByName(score_values(edges, notes))


def convert(values: DataFrame, to_unit: str = CANONICAL, conversions: tuple[Conversion, ...] = CONVERSIONS) -> DataFrame:
    """Adds `converted`: `number` of `unit_name` in `to_unit`. Null where the unit has no way to it, and for numbers without a logarithm other than 0 (0 stays 0)."""
    table = conversion_table(values.sparkSession, conversions).where(F.col("to_unit") == to_unit)
    x = F.when(F.col("logs_in"), F.col("number")).when(F.col("number") > 0, F.log10("number"))
    y = F.col("slope") * x + F.col("shift")
    value = F.when(F.col("logs_out"), y).when(~F.col("logs_in") & (F.col("number") == 0), F.lit(0.0)).otherwise(F.pow(F.lit(10.0), y))
    return values.join(F.broadcast(table), "unit_name", "left").withColumn("converted", value).drop("slope", "shift", "logs_in", "logs_out")


def found(bindingdb: DataFrame, depositor: DataFrame, edges: DataFrame, notes: DataFrame) -> DataFrame:
    """`source_table`, `record_id`, `field_name`, `unit_name` of each value not recorded in nM."""
    known = convert(quantities(bindingdb, depositor, edges, notes))
    return known.where(F.col("to_unit").isNotNull() & (F.col("unit_name") != CANONICAL)).select("source_table", "record_id", "field_name", "unit_name")
