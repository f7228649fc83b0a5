"""Edges between similar entities by exact search, block against block."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.schema import priority
from graphloom.storage import discard, materialize, read_file

#: Vectors of a block, about; neighbours of a block that are merged at once.
BLOCK, WAITING = 8192, 2_000_000
#: Similarities to exceed, by types of source and target; other pairs of types never pass.
THRESHOLDS = {("drug", "drug"): 0.9, ("drug", "ligand"): 0.9, ("ligand", "ligand"): 0.9, ("protein", "protein"): 0.99}
NEVER = 1.1


def _packed(dtype: str):
    """A block as one row: ids and unit vectors as bytes."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        v = rows["v"].combine_chunks()
        dims = np.unique(np.diff(v.offsets.to_numpy()))
        if len(dims) > 1:
            raise ValueError("vectors of a class differ in length")
        x = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims[0]).astype(dtype)
        return pa.table({"c": pa.array([key[0].as_py()], pa.string()), "own": pa.array([key[1].as_py()], pa.int32()), "dim": pa.array([dims[0]], pa.int32()), "ids": pa.array([rows["i"].to_numpy().astype(np.int64).tobytes()], pa.binary()), "x": pa.array([x.tobytes()], pa.binary())})

    return run


def _blocks(path: str, c: str, dtype: str, own: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, unit vectors) of the blocks of a class in a file, or of one of them."""
    for r in read_file(path, filters=[("c", "=", c)] + ([] if own is None else [("own", "=", own)])).to_pylist():
        x = np.frombuffer(r["x"], dtype).reshape(-1, r["dim"]).astype(np.float64)
        yield np.frombuffer(r["ids"], np.int64), x / np.linalg.norm(x, axis=1, keepdims=True)


class _Top:
    """The k best of each query so far: by cosine, then by the smaller id."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k, self.limit = ids, k, np.full(len(ids), -np.inf)
        self.row, self.who, self.cos = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, row: np.ndarray, who: np.ndarray, cos: np.ndarray) -> None:
        self.waiting.append((row, who, cos))
        self.size += len(row)
        if self.size > WAITING:
            self.merge()

    def merge(self) -> None:
        row, who, cos = (np.concatenate(x) for x in zip((self.row, self.who, self.cos), *self.waiting))
        self.waiting, self.size = [], 0
        order = np.lexsort((who, -cos, row))
        row, who, cos = row[order], who[order], cos[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < self.k
        last = place == self.k - 1
        self.limit[row[last]] = cos[last]
        self.row, self.who, self.cos = row[kept], who[kept], cos[kept]


def _all(q: np.ndarray, ids: np.ndarray, top: _Top, base: np.ndarray, base_ids: np.ndarray) -> None:
    """Adds what is no worse than the k-th best of each query."""
    for a in range(0, len(q), 1024):
        for b in range(0, len(base), 4096):
            cos = np.round(q[a : a + 1024] @ base[b : b + 4096].T, 10)
            cos[ids[a : a + 1024, None] == base_ids[None, b : b + 4096]] = -np.inf
            limit = top.limit[a : a + 1024]
            if cos.shape[1] > top.k:
                limit = np.maximum(limit, np.partition(cos, -top.k, axis=1)[:, -top.k])
            row, c = np.nonzero((cos >= limit[:, None]) & (cos > -np.inf))
            top.add(row + a, base_ids[b + c], cos[row, c])
    top.merge()


def _bounded(m: np.ndarray) -> np.ndarray:
    """Two thirds of the columns of turned unit vectors, and the length of the rest: their products are no less than the cosines."""
    turned = m @ np.linalg.qr(np.random.default_rng(11).standard_normal((m.shape[1],) * 2))[0]
    first = math.ceil(m.shape[1] * 2 / 3)
    return np.column_stack((turned[:, :first], np.linalg.norm(turned[:, first:], axis=1))).astype(np.float32)


def _above(q: np.ndarray, ids: np.ndarray, top: _Top, base: np.ndarray, base_ids: np.ndarray, bounds: np.ndarray, least: float) -> None:
    """Adds all of at least that cosine: those that the bound leaves are compared exactly."""
    turned = np.ascontiguousarray(_bounded(base).T)
    for b in range(0, len(base), 2048):
        part = np.ascontiguousarray(turned[:, b : b + 2048])
        out = np.empty((256, part.shape[1]), np.float32)
        for a in range(0, len(q), 256):
            most = np.dot(bounds[a : a + 256], part, out=out[: len(bounds[a : a + 256])])
            few = np.flatnonzero((most >= least - 1e-4).ravel())
            if not len(few):
                continue
            row, c = few // part.shape[1] + a, few % part.shape[1] + b
            for z in range(0, len(row), 100_000):
                r, j = row[z : z + 100_000], c[z : z + 100_000]
                cos = np.round(np.einsum("ij,ij->i", q[r], base[j]), 10)
                ok = (cos >= np.maximum(least, top.limit[r])) & (ids[r] != base_ids[j])
                top.add(r[ok], base_ids[j[ok]], cos[ok])


def _searched(jobs: list[tuple[str, int, str]], files: dict[str, list[str]], k: int, least: float | None, dtype: str):
    """A task: blocks of queries, each against all blocks of its class, which are read one file at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for job in batch.column("job").to_pylist():
                c, own, path = jobs[job]
                ((ids, q),) = _blocks(path, c, dtype, own)
                top = _Top(ids, k)
                bounds = None if least is None else _bounded(q)
                for file in files[c]:
                    for base_ids, base in _blocks(file, c, dtype):
                        if least is None:
                            _all(q, ids, top, base, base_ids)
                        else:
                            _above(q, ids, top, base, base_ids, bounds, least)
                top.merge()
                yield pa.RecordBatch.from_arrays([pa.array(ids[top.row]), pa.array(top.who), pa.array(top.cos)], ["i", "j", "cos"])

    return run


def top_k(vectors: DataFrame, k: int = 10, id_col: str = "global_id", vec_col: str = "features", class_col: str | None = None, least: float | None = None) -> DataFrame:
    """`i`, `j`, `cos` (10 decimals): the k most similar others of each vector within its class; ties go to the smaller id. A class of k vectors or fewer gives none.

    `least`: of these, only those of at least that cosine, which is cheaper. Blocks of vectors are written once to the shared folder; a task keeps the best of one block while
    it reads all blocks of its class, so nothing is copied, shuffled or broadcast for the comparison. Null or zero vectors take no part.
    """
    v = vectors.select(F.col(id_col).cast("bigint").alias("i"), F.col(vec_col).alias("v"), (F.col(class_col) if class_col else F.lit("")).cast("string").alias("c"))
    v = materialize(v.where("i is not null and v is not null and size(v) > 0").where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists("v", lambda x: x != 0)))
    sizes = materialize(v.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")))
    rows = v.join(sizes.select("c", "blocks"), "c").select("c", F.pmod(F.xxhash64("i"), F.col("blocks")).cast("int").alias("own"), "i", "v")
    dtype = "float32" if dict(v.dtypes)["v"] == "array<float>" else "float64"
    packed = materialize(rows.groupBy("c", "own").applyInArrow(_packed(dtype), "c string, own int, dim int, ids binary, x binary"))
    discard(v)
    jobs = [tuple(r) for r in packed.select("c", "own", F.input_file_name()).collect()]  # a row a block
    files: dict[str, list[str]] = {}
    for c, _, path in jobs:
        if path not in files.setdefault(c, []):
            files[c].append(path)
    tasks = v.sparkSession.range(0, len(jobs), 1, max(1, min(len(jobs), 10_000))).withColumnRenamed("id", "job")
    return tasks.mapInArrow(_searched(jobs, files, k, least, dtype), "i bigint, j bigint, cos double")


def similarity(cos: Column, metric: str = "squared") -> Column:
    """`squared`: 1 - 2 (1 - cos)^2, as the distance of unit vectors is already a square and is squared once more; `cosine`: the cosine."""
    return cos if metric == "cosine" else 1 - 2 * F.pow(1 - cos, F.lit(2.0))


def scaled(cos: Column) -> Column:
    """A cosine moved to 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cos + 1) / 2))


def _threshold(s: Column, t: Column, thresholds: dict[tuple[str, str], float]) -> Column:
    out = F.lit(NEVER)
    for (a, b), x in thresholds.items():
        out = F.when((s == a) & (t == b), F.lit(x)).otherwise(out)
    return out


def relation_name(a: Column, b: Column) -> Column:
    """The edge type of two entity types: the one of higher priority first."""
    return F.when(priority(a) <= priority(b), F.concat(a, F.lit("_"), b, F.lit("_similarity"))).otherwise(F.concat(b, F.lit("_"), a, F.lit("_similarity")))


def least_cosine(thresholds: dict[tuple[str, str], float], metric: str = "squared") -> float | None:
    """A cosine that every pair above the lowest threshold exceeds; None if there is none."""
    low = min(thresholds.values(), default=NEVER)
    least = (low if metric == "cosine" else 1 - math.sqrt(max(0.0, 1 - low) / 2)) - 1e-5
    return least if least > -1 else None


def candidates(vectors: DataFrame, types: DataFrame, k: int = 10, metric: str = "squared", symmetric: bool = False, class_col: str | None = None, id_col: str = "global_id", vec_col: str = "features", thresholds: dict[tuple[str, str], float] | None = None) -> DataFrame:
    """`source`, `target`, `edge_type`, `similarity` (6 decimals) of all neighbours, whatever thresholds and flags say; if thresholds are given, of those at least that can exceed the lowest of them.

    A pair counts if the larger id is among the neighbours of the smaller one, or, if symmetric, either of the other. `types` has columns id, type.
    """
    hits = top_k(vectors, k, id_col, vec_col, class_col, least_cosine(thresholds, metric) if thresholds else None)
    pairs = hits.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "cos").distinct() if symmetric else hits.where("i < j")
    out = pairs.join(types.select(F.col("id").alias("i"), F.col("type").alias("ti")), "i").join(types.select(F.col("id").alias("j"), F.col("type").alias("tj")), "j")
    swap = priority(F.col("ti")) > priority(F.col("tj"))
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    out = out.select(pick("i", "j").alias("source"), pick("j", "i").alias("target"), pick("ti", "tj").alias("source_type"), pick("tj", "ti").alias("target_type"), F.round(similarity(F.col("cos"), metric), 6).alias("similarity"))
    return out.withColumn("edge_type", relation_name(F.col("source_type"), F.col("target_type")))


def similarity_edges(found: DataFrame, thresholds: dict[tuple[str, str], float] | None = None, flags: dict[str, bool] | None = None) -> DataFrame:
    """Candidates above the threshold of their types (and, where flags are given, of an enabled edge type) as edges with source `computed`."""
    out = found.where(F.col("similarity") > _threshold(F.col("source_type"), F.col("target_type"), thresholds or THRESHOLDS))
    if flags is not None:
        on = [k for k, v in flags.items() if v]
        out = out.where(F.col("edge_type").isin(*on) if on else F.lit(False))
    return out.select("source", "target", "edge_type", F.lit("computed").alias("source_dataset"), F.col("similarity").alias("score"))


def pair_cosine(pairs: DataFrame, vectors: DataFrame, id_col: str = "global_id", vec_col: str = "features") -> DataFrame:
    """`source`, `target` and further columns of the pairs, with `cos` of their vectors; a pair with an unknown or zero vector drops out."""
    v = vectors.select(F.col(id_col).alias("_i"), F.col(vec_col).alias("_v"))
    ids = materialize(v.select("_i")).hint("merge")  # small as a file, not in memory
    both = pairs.join(ids.select(F.col("_i").alias("source")), "source", "left_semi").join(ids.select(F.col("_i").alias("target")), "target", "left_semi")  # only these meet vectors
    out = both.join(v.select(F.col("_i").alias("source"), F.col("_v").alias("_a")), "source").join(v.select(F.col("_i").alias("target"), F.col("_v").alias("_b")), "target")
    out = out.where(F.size("_a") == F.size("_b")).withColumns({c: F.col(c).cast("array<double>") for c in ("_a", "_b")})
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(dot("_a", "_a")) * F.sqrt(dot("_b", "_b"))
    return out.withColumn("cos", F.when(norm > 0, dot("_a", "_b") / norm)).where(F.col("cos").isNotNull() & ~F.isnan("cos")).drop("_a", "_b")


def tanimoto(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets given as arrays; two empty sets have 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def fingerprint(structure: Column, n: int = 3, bits: int = 2048) -> Column:
    """The set bits, as a sorted array, of a structure's pieces of n letters, each hashed to one of so many bits; shorter structures have none, null gives null."""
    return F.array_sort(F.array_distinct(F.transform(pieces(structure, n), lambda g: hash_bit(g, bits))))


def pieces(text: Column, n: int) -> Column:
    """All pieces of n letters, in order."""
    size = F.length(text) - (n - 1)
    return F.when(size > 0, F.transform(F.sequence(F.lit(1), size), lambda i: F.substr(text, i, F.lit(n)))).when(text.isNotNull(), F.array().cast("array<string>"))


def hash_bit(piece: Column, bits: int) -> Column:
    return (F.conv(F.substring(F.md5(piece), 1, 8), 16, 10).cast("bigint") % bits).cast("int")


def cluster_labels(vectors: DataFrame, k: int, seed: int = 514, id_col: str = "global_id", vec_col: str = "features") -> DataFrame:
    """`id`, `cluster` by k-means over all vectors, which must be of one length without null or NaN; an empty table gives no rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = materialize(vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")))
    if rows.isEmpty():
        return rows.select("id", F.lit(0).alias("cluster"))
    ready = rows.select("id", array_to_vector("v").alias("features"))
    return KMeans(k=k, seed=seed).fit(ready).transform(ready).select("id", F.col("prediction").alias("cluster"))


def projected(vectors: DataFrame, dim: int, seed: int = 514, id_col: str = "global_id", vec_col: str = "features") -> DataFrame:
    """Vectors brought to another dimension by a seeded random projection, the same in every run."""

    @F.pandas_udf("array<float>")
    def project(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        drawn: dict[int, np.ndarray] = {}  # a matrix for each length

        def one(x):
            x = np.asarray(x, dtype=np.float64)
            if len(x) not in drawn:
                drawn[len(x)] = np.random.default_rng([seed, len(x), dim]).standard_normal((len(x), dim)) / math.sqrt(dim)
            return (x @ drawn[len(x)]).astype(np.float32)

        for v in batches:
            yield v.map(lambda x: None if x is None else one(x))

    return vectors.select(F.col(id_col), project(F.col(vec_col)).alias(vec_col))


