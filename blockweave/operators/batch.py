"""Batches of block writes: file_id, seq, blk_idx, off, len, data (null: zeros)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .fold import fold_blocks


def aligned_last_wins(batch: DataFrame) -> DataFrame:
    """Of whole blocks written more than once, the last submitted. One partial aggregate."""
    last = batch.groupBy("file_id", "blk_idx").agg(F.max_by(F.struct("seq", "data"), "seq").alias("l"))
    return last.select("file_id", "blk_idx", F.col("l.seq").alias("seq"), F.col("l.data").alias("data"))


def merge_batch(batch: DataFrame, block_size: int, base: DataFrame | None = None) -> DataFrame:
    """Blocks after a mixed batch of whole and partial writes over their bases."""
    return fold_blocks(batch, block_size, base)


def needs_base(batch: DataFrame, block_size: int) -> DataFrame:
    """file_id, blk_idx, needs_fetch: whether the block has to be read before it is written."""
    full = (F.col("off") == 0) & (F.col("len") == block_size)
    return batch.groupBy("file_id", "blk_idx").agg((~F.bool_or(full)).alias("needs_fetch"))


def batch_sizes(batch: DataFrame, block_size: int) -> DataFrame:
    """file_id, size that a batch makes a file reach, the place inside the block counted."""
    return batch.groupBy("file_id").agg(F.max(F.col("blk_idx") * block_size + F.col("off") + F.col("len")).alias("size"))
