"""Whole files in and out of a store, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .store import BlockStore


def read_files(spark: SparkSession, root: str, block_size: int = 4096, cno: int | None = None) -> DataFrame:
    """file_id, size, mode, data of every file, now or as of a commit."""
    store = BlockStore(spark, root, block_size, cno)
    inodes = store.inodes()
    ask = inodes.select("file_id", F.lit(0).cast("long").alias("offset"), F.col("size").alias("len"))
    return inodes.select("file_id", "size", "mode").join(store.read_many(ask).select("file_id", "data"), "file_id")


def write_files(spark: SparkSession, files: DataFrame, root: str, block_size: int = 4096, token: str | None = None) -> int | None:
    """Commits whole files (file_id, data), each in place of what it held."""
    from .store import OPS

    data = F.col("data").cast("binary")
    cut = files.select("file_id", F.lit(0).cast("long").alias("seq"), F.lit("truncate").alias("op"), F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("len"), F.lit(None).cast("binary").alias("data"))
    put = files.select("file_id", F.lit(1).cast("long").alias("seq"), F.lit("write").alias("op"), F.lit(0).cast("long").alias("offset"), F.octet_length(data).cast("long").alias("len"), data.alias("data"))
    return BlockStore(spark, root, block_size).apply(cut.unionByName(put).select(*[f.name for f in OPS.fields]), token)
