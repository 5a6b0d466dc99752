"""Checkpoints: numbering, maps as of a checkpoint, differences, segment layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from ..functions.addressing import encode_micro_group, summary_bytes
from .fold import fold_blocks, patches, surviving_writes


def assign_checkpoints(ops: DataFrame, truncate_flushes: bool = True, stretch: int | None = None) -> DataFrame:
    """The operations other than flushes with cno, the checkpoint that persists them.

    A flush, and a truncate if so told, ends a checkpoint of its file.
    Checkpoints without operations get no number. stretch splits a file's log
    into stretches of so many seq values, counted on their own; only a row a
    stretch, and one a checkpoint, are counted on over a whole file.
    """
    ends = (F.col("op") == "flush") | ((F.col("op") == "truncate") & F.lit(truncate_flushes))
    ops, keys = ops.withColumn("bw_end", ends.cast("int")), ["file_id"]
    if stretch:
        ops, keys = ops.withColumn("bw_part", F.call_function("div", F.col("seq"), F.lit(stretch))), ["file_id", "bw_part"]
        per = ops.groupBy(*keys).agg(F.sum("bw_end").alias("n"))
        earlier = W.partitionBy("file_id").orderBy("bw_part").rowsBetween(W.unboundedPreceding, -1)
        ops = ops.join(per.select(*keys, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("bw_before")), keys)
    own = F.coalesce(F.sum("bw_end").over(W.partitionBy(*keys).orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    kept = ops.withColumn("bw_n", own + F.col("bw_before") if stretch else own).where("op <> 'flush'").drop("bw_end", "bw_part", "bw_before")
    numbered = kept.select("file_id", "bw_n").distinct().withColumn("cno", F.row_number().over(W.partitionBy("file_id").orderBy("bw_n")).cast("long"))
    return kept.join(numbered, ["file_id", "bw_n"]).drop("bw_n")


def as_of(ops: DataFrame, cno: int) -> DataFrame:
    """The log as a snapshot at a checkpoint sees it; later truncates do not reach into it."""
    return ops.where(F.col("cno") <= cno)


def block_map(ops: DataFrame, block_size: int, cno: int) -> DataFrame:
    """file_id, blk_idx, cno: where the current version of each surviving block was written."""
    seen = as_of(ops, cno)
    parts = patches(surviving_writes(seen), block_size).join(seen.select("file_id", "seq", "cno"), ["file_id", "seq"])
    return parts.groupBy("file_id", "blk_idx").agg(F.max("cno").alias("cno"))


def snapshot(ops: DataFrame, block_size: int, cno: int) -> DataFrame:
    """file_id, blk_idx, kind, data as of a checkpoint."""
    return fold_blocks(patches(surviving_writes(as_of(ops, cno)), block_size), block_size)


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """file_id, blk_idx, change (added, removed, changed) between two snapshots."""
    a = old.select("file_id", "blk_idx", F.lit(True).alias("in_old"), F.md5(F.coalesce("data", F.lit(b""))).alias("d_old"))
    b = new.select("file_id", "blk_idx", F.lit(True).alias("in_new"), F.md5(F.coalesce("data", F.lit(b""))).alias("d_new"))
    both = a.join(b, ["file_id", "blk_idx"], "full")
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("d_old").eqNullSafe(F.col("d_new")), "changed")
    return both.select("file_id", "blk_idx", change.alias("change")).where("change IS NOT NULL")


def touched(ops: DataFrame, block_size: int) -> DataFrame:
    """file_id, cno, blk_idx: the blocks that each checkpoint wrote, truncates inside it applied."""
    inside = ops.withColumn("bw_file", F.col("file_id")).withColumn("file_id", F.struct("file_id", "cno"))
    parts = patches(surviving_writes(inside.drop("bw_file")), block_size)
    return parts.select("file_id.file_id", "file_id.cno", "blk_idx").distinct()


def history(touches: DataFrame) -> DataFrame:
    """touches with prev_cno, the checkpoint that wrote the block before."""
    return touches.withColumn("prev_cno", F.lag("cno").over(W.partitionBy("file_id", "blk_idx").orderBy("cno")))


def segment_list(touches: DataFrame) -> DataFrame:
    """file_id, cno, n_blocks, summary_bytes of every segment."""
    return touches.groupBy("file_id", "cno").agg(F.count(F.lit(1)).alias("n_blocks")).withColumn("summary_bytes", summary_bytes(F.col("n_blocks")))


def segment_layout(touches: DataFrame, block_size: int) -> DataFrame:
    """file_id, cno, blk_idx, seq, offset, ptr: where each block of a segment stands."""
    w = W.partitionBy("file_id", "cno")
    rows = touches.withColumn("seq", (F.row_number().over(w.orderBy("blk_idx")) - 1).cast("long")).withColumn("bw_n", F.count(F.lit(1)).over(w))
    rows = rows.withColumn("offset", summary_bytes(F.col("bw_n")) + F.col("seq") * block_size)
    return rows.select("file_id", "cno", "blk_idx", "seq", "offset", encode_micro_group(F.col("cno"), F.col("offset"), F.col("seq")).alias("ptr"))


def recovery_candidates(segments: DataFrame, commits: DataFrame) -> DataFrame:
    """file_id, cno of segments that follow right after the last commit of their file but have none."""
    head = commits.groupBy("file_id").agg(F.max("cno").alias("head"))
    loose = segments.select("file_id", "cno").distinct().join(commits.select("file_id", "cno"), ["file_id", "cno"], "left_anti")
    return loose.join(head, "file_id", "left").where("cno = coalesce(head, 0) + 1").select("file_id", "cno")
