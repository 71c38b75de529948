"""Helpers that several operators share: the shared folder, durable tables, size-checked joins."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only if it was counted and has at most so many (narrow) rows.
BROADCAST_ROWS = 50_000
#: Rows sent to Python at once, and bytes of a row group of durable tables.
BATCH, ROW_GROUP = 512, 16 << 20
_BATCH, _CLEANUP = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where none is named and all runs on this machine (tests) a temporary folder is set.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: it names the folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="modelweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root if "://" in root or root.startswith("file:") else "file://" + root


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new, unused path in the shared folder; removed when the driver ends."""
    path = f"{shared_root(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # the session is gone: nothing is left to remove it with
            return


def durable(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table.

    This cuts the lineage: later reads don't depend on executors that may be lost.  The shuffle files
    of the step are released when it is written; ``drop`` deletes the table.
    """
    spark = df.sparkSession
    path = shared_path(spark, tag)
    with settings(spark, {_CLEANUP: "true"}):
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.shared_path = path
    return table


def drop(*tables: DataFrame) -> None:
    """Delete tables of ``durable`` that nothing reads any more."""
    for table in tables:
        remove(table.sparkSession, table.shared_path)
        _made.remove((table.sparkSession, table.shared_path))


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session that hold for a while."""
    before = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on sends at most BATCH rows at once to Python: rows may hold long texts, and
    each task needs a batch several times over, in the JVM and in Python."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH)) <= BATCH:
        conf.set(_BATCH, str(BATCH))
    return df


def filesystem(url: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared path, on the driver as on executors."""
    if url.startswith("file:"):
        return pafs.LocalFileSystem(), url[5:] if not url.startswith("file://") else url[7:]
    return pafs.FileSystem.from_uri(url)


def join_checked(big: DataFrame, small: DataFrame, on, how: str, rows: int) -> DataFrame:
    """Join that broadcasts ``small`` only if its counted ``rows`` are within BROADCAST_ROWS.

    Beyond that both sides are shuffled and adaptive execution splits skewed keys.
    """
    return big.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, on, how)


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into shorter ones, to bound what Python holds at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_arrow(df: DataFrame, f: Callable, schema: str, rows: int = 256, done: Callable[[], None] | None = None) -> DataFrame:
    """``mapInArrow`` over slices of at most ``rows`` rows; ``f`` maps a batch to a dict of columns.

    ``done`` is called at the end of a task, as Python workers live on after it with all that they remember."""
    out = pa_schema(schema)
    small_batches(df)

    def run(batches):
        for batch in slices(batches, rows):
            columns = f(batch)
            yield pa.RecordBatch.from_arrays([pa.array(columns[x.name], x.type) for x in out], schema=out)
        if done:
            done()

    return df.mapInArrow(run, schema)


def pa_schema(ddl: str) -> pa.Schema:
    """Arrow schema of a flat DDL string."""
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(),
        "boolean": pa.bool_(), "float": pa.float32(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
        "array<float>": pa.list_(pa.float32()), "array<boolean>": pa.list_(pa.bool_()), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string()),
    }
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def parts_for(rows: int, per_part: int) -> int:
    return max(1, math.ceil(rows / per_part))


def _importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, if it isn't installed."""
    root = str(Path(__file__).resolve().parents[2])
    own = spark.sparkContext.environment
    if root not in own.get("PYTHONPATH", "").split(":"):
        own["PYTHONPATH"] = ":".join(filter(None, (root, own.get("PYTHONPATH"))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    _importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Enough partitions for all cores where a small table has come in fewer."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
