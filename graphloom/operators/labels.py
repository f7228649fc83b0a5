"""Labelled pairs for training and testing, with negatives drawn outside all known positives."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.ranking import hash_order, hash_rank, sorted_rank
from graphloom.storage import materialize

log = logging.getLogger(__name__)

#: Draws for a positive in the first round, and for each positive on average in all rounds.
ATTEMPTS, BUDGET = 10, 100
#: Draws of a positive that are formed as one array.
RUN = 1000
#: Draws of a round up to which they are broadcast; above, all joins are by sorted shuffles, as Spark takes exploded draws for as small as the table they come from.
FEW = 100_000


def train_labels(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """`source`, `target` in dense ids (columns entity_id, global_id of `ids`); edges with an unknown end drop out."""
    a = ids.select(F.col("entity_id").alias("source_id"), F.col("global_id").alias("source"))
    b = ids.select(F.col("entity_id").alias("target_id"), F.col("global_id").alias("target"))
    return edges.select("source_id", "target_id").join(a, "source_id").join(b, "target_id").select("source", "target")


def negatives(positives: DataFrame, sources: DataFrame, targets: DataFrame, known: DataFrame, seed: int, fold: int = 0, attempts: int = ATTEMPTS) -> DataFrame:
    """`source_id`, `target_id`: at most one negative for each positive, from the pools (column entity_id), in neither direction among `known` (source_id, target_id).

    Draws are hashes of (seed, fold, number of the positive, attempt, side), so they repeat on any cluster; pairs may repeat. The first attempt that is not
    a known positive counts. One attempt is drawn for all positives, as most are free; the others are drawn for those that need them (all `attempts` count as spent).
    Positives whose attempts all fail draw again in further rounds, until each has a negative or BUDGET draws for each of all positives
    are spent; only then is the result smaller than `positives`, which is logged as a warning. Empty pools give an empty result.
    """
    s, t = (materialize(sorted_rank(p.select("entity_id").distinct(), F.col("entity_id"), name="i")) for p in (sources, targets))
    ns, nt = s.count(), t.count()
    if not ns or not nt:
        return positives.select("source_id", "target_id").limit(0)
    rows = positives.select("source_id", "target_id").withColumn("_h", hash_order(seed, "negative", F.col("source_id"), F.col("target_id")))
    number = materialize(hash_rank(rows, "_h", ties=("source_id", "target_id"), name="r").select("r"))
    taken = known.select(F.least("source_id", "target_id").alias("x"), F.greatest("source_id", "target_id").alias("y"))
    draw = lambda side, n: F.conv(F.substring(hash_order(seed, side, F.lit(fold), F.col("r"), F.col("a")), 1, 8), 16, 10).cast("bigint") % n

    def drawn(left: DataFrame, rows: int, start: int, each: int) -> DataFrame:
        """`r`, `source_id`, `target_id`: the first free one of so many attempts from `start`, for each of the rows of `left`."""
        few = rows * each <= FEW
        joined = lambda a, b, *on: (F.broadcast(a).join(b, *on) if few else a.join(b.hint("merge"), *on))
        runs = left.select("r", F.explode(F.sequence(F.lit(start), F.lit(start + each - 1), F.lit(RUN))).alias("b"))
        tries = runs.select("r", F.explode(F.sequence("b", F.least(F.col("b") + RUN, F.lit(start + each)) - 1)).alias("a")).withColumn("si", draw("source", ns)).withColumn("ti", draw("target", nt))
        pairs = joined(joined(tries, s.select(F.col("i").alias("si"), F.col("entity_id").alias("source_id")), "si"), t.select(F.col("i").alias("ti"), F.col("entity_id").alias("target_id")), "ti")
        pairs = pairs.select("r", "a", "source_id", "target_id", F.least("source_id", "target_id").alias("x"), F.greatest("source_id", "target_id").alias("y"))
        if few:
            pairs = materialize(pairs)
            free = pairs.join(taken.join(F.broadcast(pairs.select("x", "y")), ["x", "y"], "left_semi"), ["x", "y"], "left_anti")
        else:
            free = pairs.join(taken.hint("merge"), ["x", "y"], "left_anti")
        if each == 1:
            return materialize(free.select("r", "source_id", "target_id"))
        first = free.groupBy("r").agg(F.min(F.struct("a", "source_id", "target_id")).alias("m"))
        return materialize(first.select("r", "m.source_id", "m.target_id"))

    n = number.count()
    found = drawn(number, n, 0, 1)
    out, start, spent, volume = found, 1, n * attempts, n * attempts
    left, missing = number, n
    while missing := missing - found.count():
        if start < attempts:
            each = attempts - start
        else:
            volume *= 2
            each = min((n * BUDGET - spent) // missing, max(attempts, volume // missing))
            if each < 1:
                log.warning("only %d of %d negatives found in %d draws", n - missing, n, spent)
                break
            spent += each * missing
        left = materialize(left.join(found, "r", "left_anti"))
        found = drawn(left, missing, start, each)
        out, start = out.unionByName(found), start + each
    return out.select("source_id", "target_id")


def labelled(test: DataFrame, sources: DataFrame, targets: DataFrame, known: DataFrame, ids: DataFrame, seed: int, fold: int = 0) -> DataFrame:
    """`source`, `target`, `label`: test edges with label 1 and as many negatives, where found, with label 0. No test edges give no rows."""
    one = train_labels(test, ids).withColumn("label", F.lit(1))
    none = train_labels(negatives(test, sources, targets, known, seed, fold), ids).withColumn("label", F.lit(0))
    return one.unionByName(none)
