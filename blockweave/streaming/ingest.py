"""Operation logs as streams: each micro-batch is folded and committed once.

The batch number names the checkpoint, so a batch that is run again after a
failure finds its commit and does nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import catalog
from ..sources.store import BlockStore


def ingest(ops: DataFrame, store: BlockStore, checkpoint: str, ordered_by: str = "seq", trigger: dict | None = None, on_commit: Callable | None = None) -> StreamingQuery:
    """Starts a stream of operations (file_id, seq, op, offset, len, data) into a store.

    Batches must follow each other in seq for every file, as a log does.
    """

    def commit(batch: DataFrame, number: int) -> None:
        cno = store.apply(batch, token=f"stream-{checkpoint}-{number}")
        if on_commit and cno is not None:
            on_commit(cno)

    return ops.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the place that spark.checkpoint.dir names; only a local session may leave that out."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/blockweave-{uuid.uuid4().hex}"


def compare_with_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block digests after streaming the event log into a store, and after folding it as a batch."""
    at = shared_folder(spark)
    events = spark.readStream.schema(catalog.read(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    store = BlockStore(spark, f"{at}/store", block_size=catalog.SMALL)
    ops = catalog.ops_of(events, zero=True, truncate=True)
    ingest(ops, store, f"{at}/checkpoint").awaitTermination()
    streamed = catalog.folded(store.blocks())
    direct = catalog.folded(fold_all(spark, sf_dir))
    both = streamed.select("file_id", "blk_idx", F.col("digest").alias("streamed")).join(direct.select("file_id", "blk_idx", F.col("digest").alias("folded")), ["file_id", "blk_idx"], "full")
    return both.select("file_id", "blk_idx", "streamed", "folded", F.col("streamed").eqNullSafe(F.col("folded")).alias("equal"))


def fold_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import fold

    return fold.content(catalog.event_ops(spark, sf_dir, zero=True, truncate=True), catalog.SMALL)
