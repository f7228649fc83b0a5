"""Freely typed names mapped to the closest entry of a reference list, by an inverted index of character n-grams.

Typed names are deduplicated, normalised (case, Greek letters, hyphens, spaces) and looked up in an index from n-gram to reference names. N-grams are pairs of letters
up to GAP places apart, and letters with their place from the front and from the end (shared with the places beside it at half weight), so that two typing errors leave a
short name most of its n-grams. Candidates are scored by the cosine of their n-gram counts, weighted by rarity in the list. The best entry is accepted above a threshold if it
leads all other entries by a margin; entries within the margin are a tie, which the smaller edit distance decides. An exact check of the edit distance follows.
Names that are not accepted are reported with entry 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.operators.enzymes import ligand_items
from graphloom.storage import materialize

#: Accepted from this cosine on, and with this margin over all other entries (within the margin the edit distance decides).
THRESHOLD, MARGIN = 0.42, 0.08
#: Edits accepted by the exact check, as a share of the reference name's length, and the number always accepted.
EDIT_SHARE, EDITS = 0.2, 2
#: Letters of a pair are at most so many places apart.
GAP = 3
#: Reference names of a block of the index, names a task looks up in it (about), and n-gram entries scored together.
REFERENCE_BLOCK, NAME_BLOCK, ENTRIES = 20_000, 8_192, 2_000_000
#: Greek letters and their names.
GREEK = {"α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "ζ": "zeta", "κ": "kappa", "λ": "lambda", "μ": "mu", "µ": "mu", "ω": "omega"}


def typed_name(field_name: Column, value: Column) -> Column:
    """The name in a ligand field's value: the whole value of inhibitor fields, else what stands in braces after the number; null if there is none.

    Remarks in parentheses or after `;` do not belong to it. An empty name or `?` is no name.
    """
    inside = F.regexp_extract(value, r"(?s)^[^{]*\{(.*?)(?:\}|$)", 1)
    raw = F.when(field_name.startswith("inhibitor"), value).when(value.contains("{"), inside)
    bare = F.regexp_replace(raw, r"(?s)\([^)]*(?:\)|$)", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?s);.*$", ""), r"^[\s ]+|[\s ]+$", "")
    return F.when((bare != "") & (bare != "?"), bare)


def normal_name(name: Column) -> Column:
    """Lower case, Greek letters by name, only letters and digits; null where none is left."""
    out = F.lower(name)
    for letter, word in GREEK.items():
        out = F.replace(out, F.lit(letter), F.lit(word))
    return F.nullif(F.regexp_replace(out, r"[^\p{L}\p{Nd}]+", ""), F.lit(""))


def grams(names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, n-gram, count) of names, each n-gram of a name once; an n-gram is a number made of its letters, its place and its kind."""
    framed = [f"^{x}$" for x in names]
    size = np.array([len(x) for x in framed], dtype=np.int64)
    c = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(names)), size)
    at = np.arange(len(c)) - np.repeat(np.cumsum(size) - size, size)
    back = np.repeat(size, size) - 1 - at
    rows, keys, counts = [], [], []
    for gap in range(1, GAP + 1):
        i = np.flatnonzero(back >= gap)
        rows.append(row[i])
        keys.append((c[i] << 21 | c[i + gap]) << 2)
        counts.append(np.ones(len(i)))
    inner = np.flatnonzero((at > 0) & (back > 0))
    for kind, place in ((1, at), (2, back)):
        for beside, weight in ((-1, 0.5), (0, 1.0), (1, 0.5)):
            rows.append(row[inner])
            keys.append((np.minimum(place[inner] + beside, (1 << 20) - 1) << 21 | c[inner]) << 2 | kind)
            counts.append(np.full(len(inner), weight))
    row, key, count = (np.concatenate(x) for x in (rows, keys, counts))
    order = np.lexsort((key, row))
    row, key, count = row[order], key[order], count[order]
    first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])))) if len(row) else np.zeros(0, np.int64)
    return row[first], key[first], np.add.reduceat(count, first) if len(row) else count


def _runs(size: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Consecutive ranges whose sizes add up to `most` or so."""
    at = np.cumsum(size)
    out, a = [], 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(at, (at[a - 1] if a else 0) + most, side="right")))
        out.append((a, b))
        a = b
    return out


def _listed(batches):
    """(ref, keys, counts): the n-grams of every reference name."""
    for batch in batches:
        names = batch.column(0).to_pylist()
        for a, b in _runs(np.array([len(x) for x in names]), 200_000):
            row, key, count = grams(names[a:b])
            ends = pa.array(np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (key, count)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *lists], ["ref", "keys", "counts"])


class Index:
    """The inverted index of a block of reference names: postings by n-gram, weighted and scaled to length 1 by name."""

    def __init__(self, names: list[str], keys: list[np.ndarray], counts: list[np.ndarray], vocabulary: np.ndarray, weights: np.ndarray, unknown: float):
        self.names, self.unknown = np.array(names, dtype=object), unknown
        order = np.argsort(vocabulary)
        self.vocabulary, self.weights = vocabulary[order], weights[order]
        size = np.array([len(k) for k in keys], dtype=np.int64)
        ref = np.repeat(np.arange(len(names)), size)
        at = np.searchsorted(self.vocabulary, np.concatenate(keys))
        value = np.concatenate(counts) * self.weights[at]
        norm = np.sqrt(np.bincount(ref, value * value, len(names)))
        order = np.argsort(at, kind="stable")
        self.ref, self.value = ref[order], (value / norm[ref])[order]
        self.begin = np.searchsorted(at[order], np.arange(len(self.vocabulary) + 1))

    def look_up(self, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(name, reference name, cosine) for cosines of THRESHOLD or more that are within MARGIN of the name's best here."""
        row, key, count = grams(names)
        at = np.minimum(np.searchsorted(self.vocabulary, key), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == key
        weight = count * np.where(known, self.weights[at], self.unknown)
        norm = np.sqrt(np.bincount(row, weight * weight, len(names)))
        row, at, weight = row[known], at[known], (weight / norm[row])[known]
        width = self.begin[at + 1] - self.begin[at]
        n = len(self.names)
        out = []
        for a, b in _runs(np.bincount(row, width, len(names)) + n, ENTRIES):
            i, j = np.searchsorted(row, (a, b))
            w = width[i:j]
            posting = np.repeat(self.begin[at[i:j]] - np.cumsum(w) + w, w) + np.arange(int(w.sum()))
            cos = np.bincount(np.repeat((row[i:j] - a) * n, w) + self.ref[posting], np.repeat(weight[i:j], w) * self.value[posting], (b - a) * n).reshape(b - a, n)
            x, y = np.nonzero(cos >= np.maximum(cos.max(1, keepdims=True) - MARGIN, THRESHOLD))
            out.append((x + a, y, cos[x, y]))
        return tuple(np.concatenate(x) for x in zip(*out))


def _meet(names: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    if not len(names) or not len(index):
        return pd.DataFrame({"name": pd.Series(dtype=object), "ref": pd.Series(dtype=object), "score": np.zeros(0)})
    listed, words = index[index["ref"].notna()], index[index["ref"].isna()]
    work = Index(listed["ref"].tolist(), listed["keys"].tolist(), listed["counts"].tolist(), np.concatenate(words["keys"].tolist()), np.concatenate(words["counts"].tolist()), float(words["unknown"].iloc[0]))
    typed = names["name"].tolist()
    out = []
    for a, b in _runs(np.array([len(x) for x in typed]), 200_000):
        i, j, cos = work.look_up(typed[a:b])
        out.append(pd.DataFrame({"name": np.array(typed[a:b], dtype=object)[i], "ref": work.names[j], "score": cos}))
    return pd.concat(out)


def _edits_accepted(length: Column) -> Column:
    return F.greatest(F.lit(EDITS), F.floor(length * EDIT_SHARE))


def reference_names(reference: DataFrame) -> DataFrame:
    """`cid`, `ref`: each name and synonym in its normal form, once an entry; null names and entries without id drop out."""
    names = reference.where("cid is not null").select("cid", F.explode(F.concat(F.array("ligand_name"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("n"))
    return names.select("cid", normal_name(F.col("n")).alias("ref")).where("ref is not null").distinct()


def candidates(names: DataFrame, refs: DataFrame) -> DataFrame:
    """`name`, `ref`, `score`: reference names (column ref, each once) with a cosine of THRESHOLD or more that is within MARGIN of the best of their block of the index.

    Every block holds the whole vocabulary of n-grams with their weights; it has at most as many as there are pairs of letters, and letters times places, in the list,
    however many names. Names are dealt to tasks by hash and meet every block.
    """
    listed = materialize(refs.mapInArrow(_listed, "ref string, keys array<bigint>, counts array<double>"))
    n, asked = listed.count(), names.count()
    blocks = max(1, -(-n // REFERENCE_BLOCK))
    parts = max(1, -(-asked // NAME_BLOCK), min(2 * names.sparkSession.sparkContext.defaultParallelism, asked // 500))
    unknown = F.log(F.lit(1.0 + n))  # n-grams the list lacks count as the rarest
    rarity = listed.select(F.explode("keys").alias("key")).groupBy("key").agg(F.log(F.lit(1.0 + n) / F.count(F.lit(1))).alias("w"))
    words = rarity.groupBy(F.pmod(F.xxhash64("key"), F.lit(64)).alias("g")).agg(F.collect_list(F.struct("key", "w")).alias("z"))
    words = words.select(F.lit(None).cast("string").alias("ref"), F.col("z.key").alias("keys"), F.col("z.w").alias("counts"), unknown.alias("unknown"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    held = listed.select("ref", "keys", "counts", unknown.alias("unknown"), F.pmod(F.xxhash64("ref"), F.lit(blocks)).cast("int").alias("block"))
    index = held.unionByName(words).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asks = names.select("name", F.pmod(F.xxhash64("name"), F.lit(parts)).cast("int").alias("to"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("of"))
    return asks.groupBy("of", "to").cogroup(index.groupBy("block", "part")).applyInPandas(_meet, "name string, ref string, score double")


def closest(names: DataFrame, reference: DataFrame) -> DataFrame:
    """`name`, `cid`, `score`, `edits` of each distinct normal name in column `name`; cid 0 where no entry is accepted.

    A name equal to entries' names maps to the smallest of their cids. A tie within the margin that the edit distance can't decide gives no entry.
    """
    refs = materialize(reference_names(reference))
    typed = materialize(names.select("name").where("name is not null").distinct())
    exact = typed.join(refs.groupBy("ref").agg(F.min("cid").alias("cid")), F.col("name") == F.col("ref")).select("name", "cid", F.lit(1.0).alias("score"), F.lit(0).alias("edits"))
    open_names = materialize(typed.join(exact, "name", "left_anti"))
    scored = materialize(candidates(open_names, refs.select("ref").distinct()))
    rivals = scored.withColumn("top", F.max("score").over(W.partitionBy("name"))).where(F.col("score") >= F.col("top") - MARGIN)
    rivals = rivals.select("name", "ref", "score", F.levenshtein("name", "ref").alias("edits")).join(refs, "ref")
    entries = rivals.groupBy("name", "cid").agg(F.min(F.struct("edits", (-F.col("score")).alias("far"), F.length("ref").alias("length"))).alias("m"), F.max("score").alias("score"))
    order = W.partitionBy("name").orderBy("m.edits", F.desc("score"), "cid")
    ranked = entries.select("name", "cid", "score", F.col("m.edits").alias("edits"), F.col("m.length").alias("length"), F.row_number().over(order).alias("r"), F.lead("m.edits").over(order).alias("next"))
    accepted = ranked.where((F.col("r") == 1) & (F.col("next").isNull() | (F.col("edits") < F.col("next"))) & (F.col("edits") <= _edits_accepted(F.col("length"))))
    rest = open_names.join(accepted.select("name", "cid", "score", "edits"), "name", "left").select("name", F.coalesce("cid", F.lit(0)).alias("cid"), "score", "edits")
    return exact.unionByName(rest)


def named_items(brenda: DataFrame) -> DataFrame:
    """`entry_id`, `field_name`, `item_no`, `typed`, `name` (normal form, null if nothing of it is left) of every ligand item with a name."""
    items = ligand_items(brenda).select("entry_id", "field_name", "item_no", typed_name(F.col("field_name"), F.col("value")).alias("typed")).where("typed is not null")
    return materialize(items.withColumn("name", normal_name(F.col("typed"))))


def mapped(brenda: DataFrame, reference: DataFrame) -> DataFrame:
    """`entry_id`, `field_name`, `item_no`, `typed`, `cid`, `score`, `edits` of every ligand item with a name; cid 0 where the list has no such entry."""
    items = named_items(brenda)
    found_names = materialize(closest(items.select("name"), reference))
    return items.join(found_names, "name", "left").select("entry_id", "field_name", "item_no", "typed", F.coalesce("cid", F.lit(0)).cast("bigint").alias("cid"), "score", "edits")


def found(brenda: DataFrame, reference: DataFrame) -> DataFrame:
    return mapped(brenda, reference).select("entry_id", "field_name", "item_no", "cid")


def unmatched(brenda: DataFrame, reference: DataFrame) -> DataFrame:
    """`typed`, `n`: the names without an entry, as typed, and how often."""
    return mapped(brenda, reference).where("cid = 0").groupBy("typed").agg(F.count(F.lit(1)).alias("n"))
