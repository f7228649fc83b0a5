"""Feature extraction as plug-ins: an extractor for each kind of entity turns structures into vectors, and what the cache holds is not computed again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.similarity import hash_bit, pieces
from graphloom.sources.sinks import cached


def piece_counts(structure: Column, dim: int, n: int = 3) -> Column:
    """How many pieces of n letters fall on each of `dim` places by their hash, as a vector; null gives null."""
    places = F.transform(pieces(structure, n), lambda g: hash_bit(g, dim))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.when(structure.isNotNull(), F.size(F.filter(places, lambda p: p == i)).cast("float")))


@dataclass(frozen=True)
class Extractor:
    """`compute` gives `entity_id`, `features` for rows of `entity_id`, `structure`; a built-in expression or a batched pandas function. `model` names what it computes."""

    model: str
    compute: Callable[[DataFrame], DataFrame]


def hashed(dim: int, n: int = 3) -> Extractor:
    """Counts of pieces of structures; any other model can be registered in its place."""
    rows = lambda df: df.select("entity_id", piece_counts(F.col("structure"), dim, n).alias("features"))
    return Extractor(f"pieces-{n}-{dim}", rows)


@dataclass
class Extractors:
    """Extractors by kind of entity."""

    known: dict[str, Extractor] = field(default_factory=dict)

    def register(self, kind: str, extractor: Extractor) -> None:
        self.known[kind] = extractor

    def extract(self, entities: DataFrame, kind: str, cache: str | None = None, force: bool = False) -> DataFrame:
        """`entity_id`, `features` of entities (entity_id, structure); without a structure there is no row. An unknown kind raises ValueError.

        With a cache folder, vectors are kept in a table of the kind and model, and only entities it lacks are computed.
        """
        if kind not in self.known:
            raise ValueError(f"no extractor for {kind}")
        work = self.known[kind]
        rows = entities.where("structure is not null and entity_id is not null").select("entity_id", "structure").dropDuplicates(["entity_id"])
        if cache is None:
            return work.compute(rows)
        return cached(rows, f"{cache}/{kind}-{work.model}", lambda ids: work.compute(rows.join(ids, "entity_id", "left_semi")), force=force).select("entity_id", "features")
