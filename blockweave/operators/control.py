"""Range locks, flush policy, upload plans, metadata, log replay and rebasing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W


def aligned(column: Column, size: int, up: bool = False) -> Column:
    return F.call_function("div", column + (size - 1 if up else 0), F.lit(size)) * size


def lock_conflicts(ranges: DataFrame, align: int) -> DataFrame:
    """a, b, file_id of lock requests (id, file_id, start, end) that overlap once aligned to blocks.

    Instead of comparing all ranges, each is listed under the blocks it covers
    and joined on (file_id, block); a pair is reported at the later of the two
    starts, so no distinct is needed.
    """
    rows = ranges.select("id", "file_id", aligned(F.col("start"), align).alias("s"), aligned(F.col("end"), align, up=True).alias("e")).where("e > s")
    blocks = rows.select("*", F.explode(F.sequence(F.call_function("div", F.col("s"), F.lit(align)), F.call_function("div", F.col("e") - 1, F.lit(align)))).alias("blk"))
    a = blocks.select("file_id", "blk", F.col("id").alias("a"), F.col("s").alias("sa"))
    b = blocks.select("file_id", "blk", F.col("id").alias("b"), F.col("s").alias("sb"))
    return a.join(b, ["file_id", "blk"]).where((F.col("a") < F.col("b")) & (F.col("blk") * align == F.greatest("sa", "sb"))).select("file_id", "a", "b")


def conflict_counts(ranges: DataFrame, align: int) -> DataFrame:
    """file_id, n_conflicts: how many pairs of lock_conflicts() each file has, without listing them.

    In the order of their starts each range overlaps, of those before it, all
    that have not ended; so a pair is counted at its later start. Begins and
    ends are summed by place first, which leaves a row a file and border.
    """
    rows = ranges.select("file_id", aligned(F.col("start"), align).alias("s"), aligned(F.col("end"), align, up=True).alias("e")).where("e > s")
    events = rows.select("file_id", F.col("s").alias("at"), F.lit(1).alias("b"), F.lit(0).alias("e")).unionAll(rows.select("file_id", F.col("e").alias("at"), F.lit(0).alias("b"), F.lit(1).alias("e")))
    per = events.groupBy("file_id", "at").agg(F.sum("b").alias("b"), F.sum("e").alias("e"))
    before = W.partitionBy("file_id").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    still = F.coalesce(F.sum(F.col("b") - F.col("e")).over(before), F.lit(0)) - F.col("e")
    pairs = per.withColumn("n", F.col("b") * still + F.call_function("div", F.col("b") * (F.col("b") - 1), F.lit(2)))
    return pairs.groupBy("file_id").agg(F.sum("n").cast("long").alias("n_conflicts")).where("n_conflicts > 0")


def max_dirty_blocks(dirty_bytes: int, dirty_blocks: int, block_size: int) -> int:
    return max(dirty_bytes // block_size, dirty_blocks)


def flush_points(writes: DataFrame, limit: int, segment_bytes: int, block_size: int, interval: Column | None = None) -> DataFrame:
    """writes (file_id, period, seq, blk_idx) with dirty, the distinct blocks so far in the period, and needs_flush."""
    first = F.row_number().over(W.partitionBy("file_id", "period", "blk_idx").orderBy("seq")) == 1
    marked = writes.withColumn("bw_first", first.cast("int"))
    dirty = F.sum("bw_first").over(W.partitionBy("file_id", "period").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    out = marked.withColumn("dirty", dirty).drop("bw_first")
    over = (F.col("dirty") > limit) | (F.col("dirty") * block_size > segment_bytes)
    return out.withColumn("needs_flush", over if interval is None else over | interval)


def upload_plan(length: Column, chunk: int) -> dict[str, Column]:
    """Parts of a segment upload and the bytes of the last part; one part up to a chunk."""
    many = length > chunk
    parts = F.when(many, F.call_function("div", length, F.lit(chunk)) + 1).otherwise(F.lit(1).cast("long"))
    return {"parts": parts, "last_part": length - (parts - 1) * chunk}


def stat(inodes: DataFrame, block_size: int) -> DataFrame:
    """inodes (file_id, size) with blocks of 512 bytes and the preferred block size."""
    return inodes.withColumn("blocks", F.call_function("div", F.col("size") + 511, F.lit(512))).withColumn("blksize", F.lit(block_size).cast("long"))


def update_blocks(blocks: Column, diff: Column) -> Column:
    """A file's blocks of 512 bytes after it grew or shrank by diff bytes."""
    return blocks + F.signum(diff).cast("long") * F.call_function("div", F.abs(diff).cast("long") + 511, F.lit(512))


def unlink(files: DataFrame, removed: DataFrame) -> DataFrame:
    """files without those whose file_id stands in removed."""
    return files.join(removed.select("file_id"), "file_id", "left_anti")


def replay_order(log: DataFrame) -> DataFrame:
    """A write-ahead log (file_id, segid, seq, ...) as operations in replay order: (segid, seq) becomes seq."""
    ops = log.withColumn("seq", F.struct("segid", "seq"))
    kind = F.when(F.col("is_zero"), "write_zero").otherwise("write")
    return ops.select("file_id", "seq", kind.alias("op"), "offset", "len", "data")


def pending_segments(log: DataFrame, heads: DataFrame) -> DataFrame:
    """The log rows that a restart has to replay: those of segments not below the file's last checkpoint."""
    return log.join(heads.select("file_id", "head"), "file_id", "left").where("segid >= coalesce(head, 0)").drop("head")


def rebase(commits: DataFrame) -> DataFrame:
    """Commits (file_id, writer, base_cno, at) of writers that may share a base, with cno and rebased.

    The first to arrive takes base + 1; the others find it taken, fold their
    pending writes over the new head and take the numbers after it.
    """
    w = W.partitionBy("file_id", "base_cno").orderBy("at", "writer")
    place = F.row_number().over(w)
    return commits.select("file_id", "writer", "base_cno", (F.col("base_cno") + place).cast("long").alias("cno"), (place > 1).alias("rebased"))
