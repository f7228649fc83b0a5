"""Types of the engine's tables, and what is known of entity types and relations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EDGES = T.StructType(
    [
        T.StructField("source_id", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("target_id", T.StringType()),
        T.StructField("target_type", T.StringType()),
        T.StructField("relation_type", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("source_dataset", T.StringType()),
        T.StructField("raw_score", T.DoubleType()),
    ]
)
MANIFEST = T.StructType(
    [
        T.StructField("entity_id", T.StringType()),
        T.StructField("entity_type", T.StringType()),
        T.StructField("all_types", T.ArrayType(T.StringType())),
        T.StructField("all_sources", T.ArrayType(T.StringType())),
        T.StructField("structure", T.StringType()),
    ]
)
KEYS = ("source_id", "target_id", "relation_type")


@dataclass(frozen=True)
class Kind:
    metatype: str
    priority: int


#: Entity types in order of priority (the lower one wins), and the metatype of each.
KINDS = {
    "drug": Kind("molecule", 0),
    "exogenous_ligand": Kind("molecule", 1),
    "ligand": Kind("molecule", 2),
    "endogenous_ligand": Kind("molecule", 3),
    "molecule": Kind("molecule", 9),
    "enzyme": Kind("protein", 10),
    "receptor": Kind("protein", 11),
    "protein": Kind("protein", 19),
    "gene": Kind("gene", 20),
    "disease": Kind("disease", 30),
}
UNKNOWN_PRIORITY = 999
MOLECULES = tuple(k for k, v in KINDS.items() if v.metatype == "molecule")
PROTEINS = tuple(k for k, v in KINDS.items() if v.metatype in ("protein", "gene"))
RELATIONS = ("interacts_with", "inhibits", "catalyzes", "physical_association")


def _lookup(values: dict[str, object], kind: Column) -> Column:
    """A value by name from a literal map, which keeps generated code small however often it is used."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), kind)


def priority(kind: Column) -> Column:
    """The priority of an entity type; unknown and null types come last."""
    return F.coalesce(_lookup({name: k.priority for name, k in KINDS.items()}, kind), F.lit(UNKNOWN_PRIORITY))


def metatype(kind: Column) -> Column:
    """`molecule`, `protein` (genes count as proteins here), another metatype, or null for an unknown type."""
    return _lookup({name: "protein" if k.metatype == "gene" else k.metatype for name, k in KINDS.items()}, kind)
