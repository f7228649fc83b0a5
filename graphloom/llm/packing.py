"""Texts packed into containers of fixed capacity, by hierarchical packing of several context sizes.

A text is routed to the tier of the smallest context size that holds it. Tiers are packed one after another, the longest first: containers of a tier are opened by its own
texts, the longest first and the best-fitting next; the gap that is left is filled from the shorter tiers, the next shorter first. The texts a tier gave away no longer count when it is packed
itself. Packing needs only how many texts there are of each size, at most `capacity` numbers however large the corpus: a pattern of sizes that fill one container
is used as often as its sizes last. Texts then find their container by their rank among the texts of their size. Containers are dealt to step groups in order of their fill, so
that groups hold nearly equal tokens.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.llm.tokens import sizes
from graphloom.storage import bucket, materialize

#: Buckets over which texts of one size are ranked, so that a size shared by a third of all texts is ranked by many tasks.
BUCKETS = 256
#: Containers of a step group.
GROUP = 8
#: Context sizes of the tiers, as parts of the capacity.
PARTS = (1, 2, 4, 8, 16)
#: Rows of patterns that are broadcast at most (some 20 MB); more of them meet the texts in a shuffled join, over so many salts.
BROADCAST_ROWS, SALTS = 500_000, 64


def contexts_of(capacity: int) -> tuple[int, ...]:
    """The context sizes by default, the longest first."""
    return tuple(dict.fromkeys(max(1, capacity // p) for p in PARTS))


def tier(size: int, contexts: tuple[int, ...]) -> int:
    """The place, in a list of context sizes from the longest to the shortest, of the smallest one that holds a text."""
    return max(i for i, c in enumerate(contexts) if size <= c)


def _fill(sizes: list[int], left: dict[int, int], room: int, taken: dict[int, int]) -> int:
    """Takes texts of a tier (sizes in ascending order) for a container, the longest that fits first; gives the room that remains."""
    i = len(sizes) - 1
    while i >= 0 and room:
        i = min(i, bisect.bisect_right(sizes, room) - 1)
        if i < 0:
            break
        s = sizes[i]
        n = min(left[s], room // s)
        exact = bisect.bisect_left(sizes, room - s)
        if n > 1 and n * s < room and exact < len(sizes) and sizes[exact] == room - s and sizes[exact] != s:
            n = 1  # one text leaves a gap that another size fills exactly
        taken[s] = taken.get(s, 0) + n
        room -= n * s
        i -= 1
    return room


def plan(counts: dict[int, int], contexts: tuple[int, ...]) -> list[tuple[int, int, list[tuple[int, int, int]]]]:
    """Patterns (tier that opens the containers, how many, [(size, texts of it a container, rank of the first text), ...]) that hold all texts.

    Sizes are from 1 to the longest context, which is the capacity. Each pattern leaves fewer texts of one of its sizes than it holds of it, so the number of
    patterns depends on the sizes (in practice as many as there are sizes), not on the number of texts.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    used = dict.fromkeys(left, 0)
    tiers: list[list[int]] = [[] for _ in contexts]
    for s in sorted(left):
        tiers[tier(s, contexts)].append(s)
    out = []
    for t, own in enumerate(tiers):
        while own:
            taken: dict[int, int] = {}
            room = _fill(own, left, contexts[0], taken)
            for shorter in tiers[t + 1 :]:
                room = _fill(shorter, left, room, taken)
            times = min(left[s] // n for s, n in taken.items())
            out.append((t, times, [(s, n, used[s]) for s, n in taken.items()]))
            for s, n in taken.items():
                left[s] -= n * times
                used[s] += n * times
                if not left[s]:
                    tiers[tier(s, contexts)].remove(s)
    return out


def pack(documents: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", tokenizers: str | None = None, contexts: tuple[int, ...] | None = None) -> DataFrame:
    """`doc_id`, `piece_no`, `token_start`, `n_tokens`, `context` (the context size it is routed to), `container_id`, `place` (first token in the container), `container_context` (the tier that opened it), `step_group`.

    A text of more than `capacity` tokens is divided: whole containers first, then a last piece that is packed like a text. No other text is divided. Empty and
    null texts need no place: one row with 0 tokens and a null container. Repeated doc_ids are separate texts. Containers are numbered from 0.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    contexts = tuple(sorted({capacity, *(contexts_of(capacity) if contexts is None else contexts)}, reverse=True))
    if contexts[0] > capacity or contexts[-1] < 1:
        raise ValueError("context sizes must lie between 1 and the capacity")
    spark = documents.sparkSession
    sized = materialize(sizes(documents, id_col, text_col, tokenizers).withColumn("row", F.monotonically_increasing_id()))
    full = F.floor(F.col("n_tokens") / capacity)
    rest = sized.select("doc_id", "row", full.alias("full"), (F.col("n_tokens") % capacity).cast("int").alias("size"))
    some = materialize(rest.where("size > 0").withColumn("b", bucket(F.col("row"), n=BUCKETS)))

    by_size = {r["size"]: r["n"] for r in some.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity - 1 rows
    patterns = plan(by_size, contexts)
    filled = sorted(range(len(patterns)), key=lambda i: -sum(s * n for s, n, _ in patterns[i][2]))
    rows, start = [], 0
    for i in filled:
        t, times, parts = patterns[i]
        place = 0
        for s, n, first in parts:
            rows.append((s, first, first + n * times, n, place, start, contexts[t]))
            place += s * n
        start += times
    whole_at = start
    table = spark.createDataFrame(rows, "p_size int, first long, last long, each int, place int, start long, container_context int")

    # The rank of a text among those of its size: texts of its size in earlier buckets, and its row number in its own.
    per = some.groupBy("size", "b").agg(F.count(F.lit(1)).alias("n"))
    before = per.withColumn("before", F.sum("n").over(W.partitionBy("size").orderBy("b")) - F.col("n")).select("size", "b", "before")  # capacity x BUCKETS rows at most
    ranked = some.withColumn("r", F.row_number().over(W.partitionBy("size", "b").orderBy("row")) - 1).join(before, ["size", "b"]).withColumn("rank", F.col("r") + F.col("before"))
    mine = (F.col("size") == F.col("p_size")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))
    if len(rows) <= BROADCAST_ROWS:
        found = ranked.join(F.broadcast(table), mine)
    else:
        salted = table.withColumn("p_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = ranked.withColumn("salt", bucket(F.col("row"), n=SALTS)).join(salted, mine & (F.col("salt") == F.col("p_salt")))
    inside = F.col("rank") - F.col("first")
    last = found.select(
        "doc_id", F.col("full").alias("piece_no"), (F.col("full") * capacity).alias("token_start"), F.col("size").alias("n_tokens"),
        (F.col("start") + F.floor(inside / F.col("each"))).alias("container_id"), (F.col("place") + (inside % F.col("each")) * F.col("size")).alias("place"), "container_context",
    )

    # Whole containers of divided texts come after the packed ones; they are numbered by bucket in the same way.
    long = rest.where("full > 0").withColumn("b", bucket(F.col("row"), n=BUCKETS))
    per = {r["b"]: r["n"] for r in long.groupBy("b").agg(F.sum("full").alias("n")).collect()}  # BUCKETS rows at most
    offsets, at = [], whole_at
    for b, n in sorted(per.items()):
        offsets.append((b, at))
        at += n
    run = F.sum("full").over(W.partitionBy("b").orderBy("row").rowsBetween(W.unboundedPreceding, 0)) - F.col("full")
    long = long.withColumn("run", run).join(F.broadcast(spark.createDataFrame(offsets, "b int, offset long")), "b")
    long = long.select("doc_id", F.explode(F.expr("sequence(0L, full - 1)")).alias("piece_no"), (F.col("run") + F.col("offset")).alias("base"))
    long = long.select("doc_id", "piece_no", (F.col("piece_no") * capacity).alias("token_start"), F.lit(capacity).alias("n_tokens"), (F.col("base") + F.col("piece_no")).alias("container_id"), F.lit(0).alias("place"), F.lit(capacity).alias("container_context"))

    nothing = F.lit(None).cast("long")
    none = sized.where("n_tokens = 0").select("doc_id", F.lit(0).alias("piece_no"), F.lit(0).alias("token_start"), F.lit(0).alias("n_tokens"), nothing.alias("container_id"), F.lit(0).alias("place"), nothing.alias("container_context"))
    groups = max(1, -(-at // GROUP))
    routed = F.lit(None)
    for c in contexts:
        routed = F.when(F.col("n_tokens") <= c, F.lit(c)).otherwise(routed)
    out = last.unionByName(long).unionByName(none)
    return out.select(
        "doc_id", *(F.col(c).cast("bigint").alias(c) for c in ("piece_no", "token_start", "n_tokens")), F.when(F.col("n_tokens") > 0, routed).cast("bigint").alias("context"),
        *(F.col(c).cast("bigint").alias(c) for c in ("container_id", "place", "container_context")), (F.col("container_id") % groups).cast("bigint").alias("step_group"),
    )


def report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """`containers`, `tokens`, `unused_share` of a packing."""
    fill = packed.where("container_id is not null").agg((F.max("container_id") + 1).alias("containers"), F.sum("n_tokens").alias("tokens"))
    return fill.select(F.coalesce("containers", F.lit(0)).alias("containers"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(1 - F.col("tokens") / (F.col("containers") * capacity), F.lit(0.0)).alias("unused_share"))


def tier_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """By the tier that opened them: `container_context`, `containers`, `own_tokens`, `filled_tokens` (taken from shorter tiers), `unused_share`."""
    boxes = packed.where("container_id is not null").groupBy("container_id", "container_context").agg(
        F.sum(F.when(F.col("context") == F.col("container_context"), F.col("n_tokens")).otherwise(0)).alias("own"), F.sum("n_tokens").alias("tokens")
    )
    per = boxes.groupBy("container_context").agg(F.count(F.lit(1)).alias("containers"), F.sum("own").alias("own_tokens"), F.sum("tokens").alias("tokens"))
    return per.select("container_context", "containers", "own_tokens", (F.col("tokens") - F.col("own_tokens")).alias("filled_tokens"), F.round(1 - F.col("tokens") / (F.col("containers") * capacity), 6).alias("unused_share"))
