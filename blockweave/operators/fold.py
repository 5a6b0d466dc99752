"""Operation logs folded into block contents and sizes.

ops: file_id, seq, op (write, write_zero, truncate, flush), offset, len, data.
A truncate has its new size as offset. seq orders the operations of a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from ..functions.addressing import block_ranges, zeros

FAR = (1 << 63) - 1


def with_later_cut(ops: DataFrame, stretch: int | None = None) -> DataFrame:
    """ops with cut: the smallest size among later truncates of the file, or FAR.

    A written byte survives exactly if it lies below all later truncates.
    stretch splits a file's log into stretches of so many seq values: windows
    then hold one stretch of one file, and what later stretches cut comes from
    a small table of one row a stretch, so one file with most of the log does
    not meet in one task.
    """
    size = F.when(F.col("op") == "truncate", F.col("offset"))
    keys = ["file_id"]
    if stretch:
        ops = ops.withColumn("bw_part", F.call_function("div", F.col("seq"), F.lit(stretch)))
        keys.append("bw_part")
        cuts = ops.where("op = 'truncate'").groupBy("file_id", "bw_part").agg(F.min("offset").alias("bw_min"))
        # a row for every stretch, not only those with cuts
        parts = ops.select("file_id", "bw_part").distinct().join(cuts, ["file_id", "bw_part"], "left")
        after = W.partitionBy("file_id").orderBy("bw_part").rowsBetween(1, W.unboundedFollowing)
        parts = parts.select("file_id", "bw_part", F.min("bw_min").over(after).alias("bw_after"))
        ops = ops.join(parts, ["file_id", "bw_part"])
    later = F.min(size).over(W.partitionBy(*keys).orderBy("seq").rowsBetween(1, W.unboundedFollowing))
    cut = F.least(later, F.col("bw_after")) if stretch else later
    return ops.withColumn("cut", F.coalesce(cut, F.lit(FAR))).drop("bw_part", "bw_after")


def surviving_writes(ops: DataFrame, stretch: int | None = None) -> DataFrame:
    """The writes and zero writes with offset and len clipped to what later truncates leave; empty ones go."""
    cut = with_later_cut(ops, stretch).where("op IN ('write', 'write_zero')")
    return cut.withColumn("len", F.least(F.col("offset") + F.col("len"), "cut") - F.col("offset")).where("len > 0")


def final_sizes(ops: DataFrame, stretch: int | None = None) -> DataFrame:
    """file_id, size after all operations: the last truncate, grown by the writes after it."""
    cut = with_later_cut(ops, stretch)
    last = F.max(F.when(F.col("op") == "truncate", F.struct("seq", "offset")))["offset"]
    grown = F.max(F.when(F.col("op").isin("write", "write_zero") & (F.col("cut") == FAR) & (F.col("len") > 0), F.col("offset") + F.col("len")))
    return cut.groupBy("file_id").agg(F.greatest(F.coalesce(last, F.lit(0)), F.coalesce(grown, F.lit(0))).cast("long").alias("size"))


def patches(writes: DataFrame, block_size: int) -> DataFrame:
    """file_id, blk_idx, seq, off, len, data (null: zeros): the writes cut at block borders. Narrow."""
    rows = writes.select("file_id", "seq", F.col("offset").alias("bw_start"), F.col("data").alias("bw_data"), (F.col("op") == "write_zero").alias("bw_zero"), F.inline(block_ranges(F.col("offset"), F.col("len"), block_size)))
    at = F.col("blk_idx") * block_size + F.col("off") - F.col("bw_start")
    piece = F.when(~F.col("bw_zero"), F.substring("bw_data", at.cast("int") + 1, F.col("len").cast("int")))
    return rows.select("file_id", "blk_idx", "seq", F.col("off").cast("int").alias("off"), F.col("len").cast("int").alias("len"), piece.alias("data"))


def overlaid(base: Column, parts: Column) -> Column:
    """A block with patches (seq, off, len, data) laid over it in order; data null: zeros."""
    return F.aggregate(parts, base, lambda b, p: F.call_function("overlay", b, F.coalesce(p["data"], zeros(p["len"])), p["off"] + 1, p["len"]))


def fold_blocks(parts: DataFrame, block_size: int, base: DataFrame | None = None) -> DataFrame:
    """file_id, blk_idx, kind, data, n_parts of the blocks that parts touch.

    Patches before the last one that fills the whole block cannot show and are
    left out before anything is gathered; blocks with such a patch never read
    their base (file_id, blk_idx, data). Missing bases are zeros. A block that
    comes out all zero has kind 'zero' and null data. A block's remaining
    patches meet in one row, so its memory is bounded by what was written to
    one block since it was last filled.
    """
    keys = ["file_id", "blk_idx"]
    full = (F.col("off") == 0) & (F.col("len") == block_size)
    filled = parts.where(full).groupBy(*keys).agg(F.max("seq").alias("bw_full"))
    kept = parts.join(filled, keys, "left").where("bw_full IS NULL OR seq >= bw_full")
    grouped = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "off", "len", "data"))).alias("bw_parts"), F.max("bw_full").alias("bw_full"))
    start = zeros(F.lit(block_size))
    if base is not None:
        held = base.select(*keys, F.col("data").alias("bw_base"))
        partial = grouped.where("bw_full IS NULL").join(held, keys, "left")
        grouped = partial.unionByName(grouped.where("bw_full IS NOT NULL"), allowMissingColumns=True)
        start = F.call_function("rpad", F.coalesce("bw_base", F.lit(b"")), F.lit(block_size), F.lit(b"\x00"))
    out = grouped.select(*keys, overlaid(start, F.col("bw_parts")).alias("data"), F.size("bw_parts").alias("n_parts"))
    zero = F.col("data") == zeros(F.lit(block_size))
    return out.select(*keys, F.when(zero, "zero").otherwise("data").alias("kind"), F.when(~zero, F.col("data")).alias("data"), "n_parts")


def content(ops: DataFrame, block_size: int, stretch: int | None = None) -> DataFrame:
    """The touched blocks after all operations of a log that starts from empty files."""
    return fold_blocks(patches(surviving_writes(ops, stretch), block_size), block_size)
