"""Files as blocks: splitting, random reads with zero fill, reassembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.addressing import block_ranges, zeros


def split_blocks(files: DataFrame, block_size: int, id_col="file_id", data_col="data") -> DataFrame:
    """file_id, blk_idx, len, data: the blocks of each file; the last one may be short. Narrow."""
    data = F.col(data_col).cast("binary")
    parts = block_ranges(F.lit(0), F.coalesce(F.octet_length(data), F.lit(0)), block_size)
    rows = files.select(F.col(id_col).alias("file_id"), data.alias("bw_data"), F.inline(parts))
    piece = F.substring("bw_data", F.col("blk_idx").cast("int") * block_size + 1, F.col("len").cast("int"))
    return rows.select("file_id", "blk_idx", "len", piece.alias("data"))


def reassemble(blocks: DataFrame) -> DataFrame:
    """file_id, n_blocks, data of files whose blocks are all there."""
    return blocks.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.expr("listagg(data) WITHIN GROUP (ORDER BY blk_idx)").alias("data"))


def read_ranges(requests: DataFrame, sizes: DataFrame, blocks: DataFrame, block_size: int) -> DataFrame:
    """Random reads: file_id, offset, bytes_read, zero_bytes, data for each request (file_id, offset, len).

    Ranges are clamped to the file's size (sizes: file_id, size); reads at or
    beyond it give no bytes. Blocks that are missing, null or short read as
    zeros. A request touches only its own blocks: the join is on (file_id,
    blk_idx), so the scan of blocks can be pruned by both. zero_bytes counts
    the bytes of missing blocks.
    """
    asked = requests.join(sizes.select("file_id", "size"), "file_id")
    clamped = F.greatest(F.least(F.col("len"), F.col("size") - F.col("offset")), F.lit(0))
    asked = asked.select("file_id", "offset", clamped.cast("long").alias("bytes_read"))
    parts = asked.select("file_id", "offset", "bytes_read", F.inline_outer(block_ranges(F.col("offset"), F.col("bytes_read"), block_size)))
    found = parts.join(blocks.select("file_id", "blk_idx", "data"), ["file_id", "blk_idx"], "left")
    padded = F.call_function("rpad", F.coalesce("data", F.lit(b"")), F.lit(block_size), F.lit(b"\x00"))
    piece = F.when(F.col("len").isNotNull(), F.substring(padded, F.col("off").cast("int") + 1, F.col("len").cast("int")))
    found = found.select("file_id", "offset", "bytes_read", "blk_idx", piece.alias("piece"), F.when(F.col("data").isNull(), F.col("len")).otherwise(0).alias("zero"))
    return found.groupBy("file_id", "offset", "bytes_read").agg(F.sum(F.coalesce("zero", F.lit(0))).cast("long").alias("zero_bytes"), F.coalesce(F.expr("listagg(piece) WITHIN GROUP (ORDER BY blk_idx)"), F.lit(b"")).alias("data"))


def duplicate_blocks(blocks: DataFrame) -> DataFrame:
    """digest, copies, files of block contents that stand more than once."""
    return blocks.groupBy(F.md5("data").alias("digest")).agg(F.count(F.lit(1)).alias("copies"), F.countDistinct("file_id").alias("files")).where("copies > 1")


__all__ = ["split_blocks", "reassemble", "read_ranges", "duplicate_blocks", "zeros"]
