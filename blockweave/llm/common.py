"""Helpers shared by the text operators."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of the word separators [\x20\x09-\x0D]; bytes.split() splits on exactly these.
SPACES = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.lru_cache(maxsize=1)
def _libc():
    import ctypes

    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library; its memory is its own affair
        return None


def release() -> None:
    """Hands freed memory back to the system, as workers wait for their next task with all they ever held."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None and hasattr(_libc(), "malloc_trim"):
        _libc().malloc_trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """run, for mapInArrow, with release() once a task ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def map_batches(
    df: DataFrame, schema: StructType, make: Callable[[], Callable[[pa.RecordBatch], Iterable[list]]]
) -> DataFrame:
    """mapInArrow whose function is built once a task.

    make() runs on the executor and returns a function from a record batch to
    the output columns, as a list of one sequence a column. Rows are never
    gathered beyond a batch, so memory is bounded by one batch of input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(schema)
        step = make()
        for batch in batches:
            if batch.num_rows:
                columns = [pa.array(c, type=f.type) if not isinstance(c, pa.Array) else c for c, f in zip(step(batch), target)]
                yield pa.RecordBatch.from_arrays(columns, schema=target)

    return df.mapInArrow(released(run), schema)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, also where lambdas inside body use it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Bytes that a broadcast table may hold; what is larger is joined by a shuffle.
BROADCAST_BYTES = 16 << 20


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for a broadcast if its rows, counted, stay below the limit at row_bytes each; else df."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


PREFIX = "blockweave-"


def shared_root(spark: SparkSession) -> str:
    """The shared place the cluster names in spark.checkpoint.dir.

    Where that is unset, a local session takes its warehouse folder. A cluster's
    executors may share no such folder, so there the setting must be given.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    return root.rstrip("/")


def stage_dir(spark: SparkSession) -> str:
    """A new folder in the shared place."""
    return f"{shared_root(spark)}/{PREFIX}{uuid.uuid4().hex}"


def materialize(spark: SparkSession, df: DataFrame, at: str, name: str) -> DataFrame:
    """Write df under the shared folder and read it back.

    The written table cuts the lineage and survives the loss of executors.
    """
    df.write.mode("overwrite").parquet(f"{at}/{name}")
    return spark.read.schema(df.schema).parquet(f"{at}/{name}")


def _files(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def discard(spark: SparkSession, at: str, names: Iterable[str] | None = None, keep: Iterable[str] = ()) -> None:
    """Deletes tables below a stage folder: those named, or all but those in keep."""
    fs, path = _files(spark, at)
    if not fs.exists(path):
        return
    keep = set(keep)
    names = [s.getPath().getName() for s in fs.listStatus(path)] if names is None else list(names)
    for name in names:
        if name not in keep:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{at}/{name}"), True)


def sweep(spark: SparkSession, older_than_s: float) -> list[str]:
    """Deletes the stage folders below the shared place that nothing has touched for so long; their names.

    A result reads its last tables until it is written, so give the longest time a job may take.
    """
    import time

    fs, path = _files(spark, shared_root(spark))
    gone = []
    for s in fs.listStatus(path) if fs.exists(path) else []:
        name = s.getPath().getName()
        if name.startswith(PREFIX) and s.getModificationTime() < (time.time() - older_than_s) * 1000:
            fs.delete(s.getPath(), True)
            gone.append(name)
    return gone
