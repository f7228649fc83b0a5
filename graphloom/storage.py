"""Reading of tables, and cutting of lineage through tables in the shared folder of the cluster."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_run = uuid.uuid4().hex
_local: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, only where that is unset (tests), a folder of this machine."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if there:
        return there.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="graphloom-"))
    return f"file://{_local[0]}"


def fresh_path(spark: SparkSession) -> str:
    """A new place in the shared folder, deleted as tables of `materialize` are."""
    path = f"{shared_dir(spark)}/graphloom-{_run}/{uuid.uuid4().hex}"
    if not _started:
        _started.append(spark)
        atexit.register(_clean, spark, f"{shared_dir(spark)}/graphloom-{_run}")
    if _scopes:
        _scopes[-1].append(path)
    return path


def materialize(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Writes df as a table of the shared folder and reads it again.

    The result no longer depends on executors' disks or on earlier stages, so it survives lost executors.
    The table is deleted by `discard`, at the end of the `scratch` block it was made in, or when the Python process ends.
    """
    spark = df.sparkSession
    path = fresh_path(spark)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._graphloom_table = path
    return out


_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialized within the block are deleted at its end; results must have been written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _clean(spark, path)


def discard(df: DataFrame) -> None:
    """Deletes the table of a materialized DataFrame that nothing will read again; any other DataFrame is left alone."""
    if path := getattr(df, "_graphloom_table", None):
        _clean(df.sparkSession, path)


_started: list[SparkSession] = []


def _clean(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended: a local folder can still go
        if path.startswith("file://"):
            import shutil

            shutil.rmtree(path[7:], ignore_errors=True)


def spread(df: DataFrame, *keys: str, factor: int = 3) -> DataFrame:
    """Repartitions an input by keys if its scan gives fewer tasks than would use all cores; a large input stays as it is.

    The number of tasks is told from the plan's size in bytes, which runs no job.
    """
    spark = df.sparkSession
    want = factor * spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return df.repartition(want, *keys) if size < want * split else df


def read_file(path: str, **options):
    """A file of a materialized table (one of its `inputFiles`) as an Arrow table, read within a task: many tasks share one table without a shuffle. Options are those of pyarrow.parquet.read_table."""
    from pyarrow import fs, parquet

    system, at = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path)
    return parquet.read_table(at, filesystem=system, partitioning=None, **options)


def bucket(*cols, n: int):
    """A hash bucket from 0 to n-1 of the given columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")
