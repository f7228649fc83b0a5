"""Row filters: affinities, thresholds by relation, property bounds that sources may relax, validation of entities."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import affinity, positive_id, valid_sequence
from graphloom.schema import MOLECULES


def affinities(raw: DataFrame, columns: tuple[str, ...] = ("ki", "kd", "ic50")) -> DataFrame:
    """Adds `raw_score`: the first of the columns, in that order, that is a number after `<` and `>` are taken away."""
    return raw.withColumn("raw_score", F.coalesce(*(affinity(F.col(c)) for c in columns)))


def at_most(df: DataFrame, threshold: float, column: str = "raw_score") -> DataFrame:
    """Rows with a value up to the threshold; nulls and NaN fail."""
    return df.where(F.col(column).isNotNull() & ~F.isnan(column) & (F.col(column) <= threshold))


def by_relation(edges: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Edges whose score is within the threshold of their relation; a null score fails where there is a threshold, other relations pass."""
    cond = F.lit(True)
    for relation, t in thresholds.items():
        cond = F.when(F.col("relation_type") == relation, F.col("raw_score") <= F.lit(t)).otherwise(cond)
    return edges.where(F.coalesce(cond, F.lit(False)))


@dataclass(frozen=True)
class Bounds:
    """Bounds on properties; None sets none. `check_pains` rejects structures with an alert."""

    mw_min: float | None = None
    mw_max: float | None = None
    logp_min: float | None = None
    logp_max: float | None = None
    hbd_max: float | None = None
    hba_max: float | None = None
    qed_min: float | None = None
    sa_max: float | None = None
    check_pains: bool = False


#: Column of the property table that each bound speaks of.
PROPERTY = {"mw": "MW", "logp": "LogP", "hbd": "HBD", "hba": "HBA", "qed": "QED", "sa": "SA_Score"}
LIMITS = tuple(f.name for f in fields(Bounds) if f.name != "check_pains")


def static_filter(bounds: Bounds | None) -> Column:
    """Whether a row of properties is within fixed bounds; None (filtering disabled) lets all rows pass. A null property fails a bound on it."""
    cond = F.lit(True)
    if bounds is None:
        return cond
    for name in LIMITS:
        value, column = getattr(bounds, name), F.col(PROPERTY[name[:-4]])
        if value is not None:
            cond = cond & ((column >= F.lit(float(value))) if name.endswith("min") else (column <= F.lit(float(value))))
    if bounds.check_pains:
        cond = cond & ~F.col("is_pains")
    return F.coalesce(cond, F.lit(False))


@dataclass(frozen=True)
class SourceRules:
    """General bounds (None: filtering disabled) and those of single sources (None: that source sets no limits)."""

    general: Bounds | None = None
    sources: dict[str, Bounds | None] = field(default_factory=dict)


def criteria(rules: SourceRules) -> dict[str, Column]:
    """The bounds of each entity as columns: the general ones, relaxed by every source in `all_sources` that has rules of its own.

    The widest bound wins, an alert counts only if all of them check it, and a bound that a source leaves out is no bound.
    """
    inf = float("inf")
    default = lambda b, name: (-inf if name.endswith("min") else inf) if b is None or getattr(b, name) is None else float(getattr(b, name))
    out = {}
    for name in LIMITS:
        widest = F.least if name.endswith("min") else F.greatest
        parts = [F.lit(default(rules.general, name))]
        parts += [F.when(F.array_contains("all_sources", s), F.lit(default(b, name))) for s, b in rules.sources.items()]
        out[f"c_{name}"] = widest(*parts) if len(parts) > 1 else parts[0]
    pains = F.lit(bool(rules.general and rules.general.check_pains))
    for s, b in rules.sources.items():
        pains = pains & ~(F.coalesce(F.array_contains("all_sources", s), F.lit(False)) & F.lit(not (b and b.check_pains)))
    return out | {"c_check_pains": pains}


def dynamic_filter(df: DataFrame, rules: SourceRules) -> DataFrame:
    """Adds `passes`: whether a row's properties are within its own bounds. A null property passes only where there is no bound on it."""
    out = df.withColumns(criteria(rules))
    cond = F.lit(True)
    for name in LIMITS:
        column, bound = F.col(PROPERTY[name[:-4]]), F.col(f"c_{name}")
        free = bound == F.lit(float("-inf") if name.endswith("min") else float("inf"))
        cond = cond & (free | ((column >= bound) if name.endswith("min") else (column <= bound)))
    cond = cond & (~F.col("is_pains") | ~F.col("c_check_pains"))
    return out.withColumn("passes", F.coalesce(cond, F.lit(False))).drop(*(f"c_{n}" for n in LIMITS), "c_check_pains")


def validated(entities: DataFrame, properties: DataFrame, rules: SourceRules, whitelist: DataFrame) -> DataFrame:
    """Adds `valid`, `reason` to a manifest.

    Molecules need a positive whole id, a structure in the property table (with MW and LogP) and properties within their bounds; proteins an id in the
    whitelist (column entity_id) and a sequence of residue letters. All other types are rejected.
    """
    props = properties.where("MW is not null and LogP is not null").dropDuplicates(["structure"])
    white = whitelist.select("entity_id", F.lit(True).alias("_white")).where("entity_id is not null").distinct()
    rows = dynamic_filter(entities.join(props, "structure", "left").join(white, "entity_id", "left"), rules)
    molecule, protein = F.col("entity_type").isin(*MOLECULES), F.col("entity_type") == "protein"
    reason = (
        F.when(molecule & positive_id(F.col("entity_id")).isNull(), "id")
        .when(molecule & F.col("MW").isNull(), "structure")
        .when(molecule & ~F.col("passes"), "properties")
        .when(protein & F.col("_white").isNull(), "whitelist")
        .when(protein & ~valid_sequence(F.col("structure")), "sequence")
        .when(~F.coalesce(molecule | protein, F.lit(False)), "type")
    )
    return rows.withColumn("reason", reason).select(*entities.columns, F.col("reason").isNull().alias("valid"), "reason")
