"""Samples of exact size, repeatable on any cluster: rows are ordered by a hash of their key, never drawn by partition."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.ranking import hash_order, hash_rank
from graphloom.schema import KEYS


def edge_order(seed: int, purpose: str) -> Column:
    return hash_order(seed, purpose, *(F.col(k) for k in KEYS))


def exact(df: DataFrame, n: int, seed: int, purpose: str = "sample", key: tuple[str, ...] = KEYS) -> DataFrame:
    """Exactly n rows, or ValueError if there are fewer. Keys should be unique; repeated ones are ordered arbitrarily among themselves."""
    if n > (have := df.count()):
        raise ValueError(f"{n} rows asked of {have}")
    return hash_rank(df.withColumn("_h", hash_order(seed, purpose, *(F.col(k) for k in key))), "_h").where(F.col("rank") < n).drop("_h", "rank")


def uniform(df: DataFrame, fraction: float, seed: int, purpose: str = "uniform", key: tuple[str, ...] = KEYS) -> DataFrame:
    """ceil(rows * fraction) rows; all from a fraction of 1."""
    return df if fraction >= 1 else exact(df, math.ceil(df.count() * fraction), seed, purpose, key)


def sample(df: DataFrame, n: int | None = None, fraction: float | None = None, seed: int = 514, key: tuple[str, ...] = KEYS) -> DataFrame:
    """Exactly n rows if n is given (ValueError if there are fewer), else `fraction` of them, rounded half to even; all rows from a fraction of 1, or if neither is given."""
    if n is None:
        if fraction is None or fraction >= 1:
            return df
        n = round(fraction * df.count())
    return exact(df, n, seed, "sample", key)


@dataclass(frozen=True)
class Stratum:
    """Edges for which `where` (SQL or a Column) holds (and no earlier stratum's does): a fraction of them, or `ratio` edges for each edge of the stratum `ratio_to`."""

    name: str
    where: Column | str
    fraction: float | None = None
    ratio_to: str | None = None
    ratio: float = 1.0


def quotas(strata: list[Stratum], counts: dict[str, int]) -> dict[str, int]:
    """How many edges to keep of each stratum.

    Fractions first: ceil(count * fraction). Then ratios, up to all there are, of the anchor's sampled count if the anchor has a fraction, of its whole count if
    the anchor is itself defined by a ratio. An unknown anchor raises ValueError; an empty anchor gives 0.
    """
    have = {s.name: counts.get(s.name, 0) for s in strata}
    out = {s.name: math.ceil(have[s.name] * (1.0 if s.fraction is None else s.fraction)) for s in strata if s.ratio_to is None}
    base = have | out
    for s in strata:
        if s.ratio_to is not None:
            if s.ratio_to not in have:
                raise ValueError(f"stratum {s.name} refers to {s.ratio_to}, which is not defined")
            out[s.name] = min(math.ceil(base[s.ratio_to] * s.ratio), have[s.name])
    return out


def stratified(edges: DataFrame, strata: list[Stratum], seed: int) -> DataFrame:
    """A sample of exact size from each stratum; edges of no stratum are all kept. Only a count a stratum reaches the driver."""
    name = F.lit(None).cast("string")
    for s in reversed(strata):
        name = F.when(F.coalesce(F.expr(s.where) if isinstance(s.where, str) else s.where, F.lit(False)), F.lit(s.name)).otherwise(name)
    rows = edges.withColumn("_stratum", name)
    counts = {r["_stratum"]: r["n"] for r in rows.groupBy("_stratum").agg(F.count(F.lit(1)).alias("n")).collect()}
    keep = quotas(strata, counts)
    ranked = hash_rank(rows.withColumn("_h", edge_order(seed, "stratified")), "_h", ("_stratum",))
    quota = F.lit(0)
    for n, q in keep.items():
        quota = F.when(F.col("_stratum") == n, F.lit(q)).otherwise(quota)
    return ranked.where(F.col("_stratum").isNull() | (F.col("rank") < quota)).select(*edges.columns)
