"""The query catalogue: name -> plan, and name -> the same result in SQL.

The operation log of the queries is derived from events: a file for each user,
in order of time, eight bytes of the event's number written at a place inside
SPACE. Block contents are compared by the md5 of their hex text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import addressing as A, dumps, modes, names
from ..operators import batch, blocks, control, fold, snapshots

BLOCK, SPACE, SMALL = 4096, 4096, 256
DAY = 86_400_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("file_id"), F.col("text").cast("binary").alias("data"))


def payload(number: Column) -> Column:
    return F.unhex(F.lpad(F.hex(number), 16, "0"))


def event_ops(spark: SparkSession, sf_dir: str, zero: bool = False, truncate: bool = False) -> DataFrame:
    return ops_of(read(spark, sf_dir, "events"), zero, truncate)


def ops_of(events: DataFrame, zero: bool = False, truncate: bool = False) -> DataFrame:
    """The derived log, with day; error events write zeros and signup events truncate, if so told."""
    e = events.where("event_id IS NOT NULL AND ts IS NOT NULL AND user_id IS NOT NULL")
    op = F.when((F.col("event_type") == "error") & F.lit(zero), "write_zero").when((F.col("event_type") == "signup") & F.lit(truncate), "truncate").otherwise("write")
    seq = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = e.select(F.col("user_id").alias("file_id"), seq.alias("seq"), op.alias("op"), (F.col("event_id") * 37 % SPACE).alias("offset"), payload(F.col("event_id")).alias("data"), "event_id")
    return rows.select("file_id", "seq", "op", "offset", F.when(F.col("op") == "truncate", 0).otherwise(8).cast("long").alias("len"), F.when(F.col("op") == "write", F.col("data")).alias("data"), F.call_function("div", "seq", F.lit(DAY)).alias("day"), "event_id")


def numbered_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole log with cno: a flush at the end of every day that a file was written."""
    ops = event_ops(spark, sf_dir, zero=True, truncate=True).withColumn("seq", F.col("seq") * 2)
    flush = ops.select("file_id", "day").distinct().select("file_id", ((F.col("day") + 1) * DAY * 2 - 1).alias("seq"), F.lit("flush").alias("op"), F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("len"), F.lit(None).cast("binary").alias("data"), "day", F.lit(None).cast("long").alias("event_id"))
    return snapshots.assign_checkpoints(ops.unionByName(flush), truncate_flushes=False, stretch=60 * DAY)


def digest(block_size: int) -> Column:
    return F.md5(F.hex(F.coalesce("data", A.zeros(F.lit(block_size))))).alias("digest")


def folded(df: DataFrame, block_size: int = SMALL) -> DataFrame:
    return df.select("file_id", "blk_idx", "kind", digest(block_size))


def q01_block_split(spark, sf_dir):
    return blocks.split_blocks(files(spark, sf_dir), BLOCK).select(F.col("file_id").alias("doc_id"), "blk_idx", "len", F.md5("data").alias("digest"))


def q02_reassemble(spark, sf_dir):
    whole = blocks.reassemble(blocks.split_blocks(files(spark, sf_dir), BLOCK))
    return whole.select(F.col("file_id").alias("doc_id"), "n_blocks", F.octet_length("data").cast("long").alias("n_bytes"), F.md5("data").alias("digest"))


def _read(spark, sf_dir, offset: Column, length: Column, keep: Column | None = None):
    data = files(spark, sf_dir)
    sizes = data.select("file_id", F.octet_length("data").cast("long").alias("size"))
    held = blocks.split_blocks(data, BLOCK)
    asked = sizes.select("file_id", offset.cast("long").alias("offset"), length.cast("long").alias("len"))
    return blocks.read_ranges(asked, sizes, held if keep is None else held.where(keep), BLOCK)


def q03_range_read(spark, sf_dir):
    return _read(spark, sf_dir, F.lit(1000), F.lit(5000)).select(F.col("file_id").alias("doc_id"), "bytes_read", F.md5("data").alias("digest"))


def q04_read_past_eof(spark, sf_dir):
    return _read(spark, sf_dir, F.greatest(F.col("size") - 50 + 40 * F.pmod("file_id", F.lit(3)), F.lit(0)), F.lit(100)).select(F.col("file_id").alias("doc_id"), "bytes_read", F.md5("data").alias("digest"))


def q05_sparse_read(spark, sf_dir):
    out = _read(spark, sf_dir, F.lit(0), F.col("size"), F.col("blk_idx") % 2 == 1)
    return out.select(F.col("file_id").alias("doc_id"), "bytes_read", "zero_bytes", F.md5(F.hex("data")).alias("digest"))


def _pointer_parts(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    return li.select((F.col("l_orderkey") * 131 % A.SEGMENT_LIMIT).alias("segid"), (F.col("l_partkey") % A.UNIT_LIMIT * BLOCK).alias("offset"), ((F.col("l_suppkey") * 16 + F.col("l_linenumber")) % (1 << 18)).alias("seq"))


def q06_ptr_micro_group(spark, sf_dir):
    rows = _pointer_parts(spark, sf_dir).withColumn("ptr", A.encode_micro_group(F.col("segid"), F.col("offset"), F.col("seq")))
    p = F.col("ptr")
    return rows.select("segid", "offset", "seq", "ptr", A.decode_segid(p).alias("d_segid"), A.decode_unit_offset(p).alias("d_offset"), A.decode_group(p).alias("d_group"))


def q07_ptr_flat(spark, sf_dir):
    rows = _pointer_parts(spark, sf_dir).withColumn("ptr", A.encode_flat(F.col("segid"), F.col("offset")))
    return rows.select("segid", "offset", "ptr", A.decode_segid(F.col("ptr")).alias("d_segid"), A.decode_flat_offset(F.col("ptr")).alias("d_offset"))


def q08_ptr_classify(spark, sf_dir):
    rows = _pointer_parts(spark, sf_dir)
    case = F.col("seq") % 5
    ptr = F.when(case == 0, A.ZERO_BLOCK).when(case == 1, A.DUMMY).when(case == 2, A.INVALID).when(case == 3, F.col("segid")).otherwise(A.encode_micro_group(F.col("segid"), F.col("offset"), F.col("seq")))
    rows = rows.select(ptr.alias("ptr"))
    return rows.groupBy(A.pointer_kind(F.col("ptr")).alias("kind"), A.display(F.col("ptr")).alias("shown")).agg(F.count(F.lit(1)).alias("n"))


def q09_meta_config_codec(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", (F.lit(1000) * F.col("p_size")).cast("long").alias("meta"), (F.lit(3333) * F.col("p_size")).cast("long").alias("block"), (F.col("p_partkey") % 3).alias("form"))
    rows = p.withColumn("word", A.pack_meta_config(F.col("meta"), F.col("block"), F.col("form")))
    fields = A.unpack_meta_config(F.col("word"))
    return rows.select("p_partkey", "word", *[c.cast("long").alias(n) for n, c in fields.items()], A.unpack_map_data(A.pack_map_data(F.col("form"))).alias("form_name"))


def q10_aligned_last_wins(spark, sf_dir):
    e = event_ops(spark, sf_dir)
    rows = e.select(F.lit(0).alias("file_id"), F.col("file_id").alias("blk_idx"), "seq", "data")
    return batch.aligned_last_wins(rows).select("blk_idx", F.hex("data").alias("data_hex"))


def _mixed(spark, sf_dir):
    """Blocks of 32 bytes: every fifth event a whole one, the others eight bytes cut at the block's end."""
    e = event_ops(spark, sf_dir)
    full = F.col("event_id") % 5 == 0
    off = F.when(full, 0).otherwise(F.col("event_id") * 13 % 32).cast("int")
    rows = e.select(F.lit(0).alias("file_id"), F.col("file_id").alias("blk_idx"), "seq", off.alias("off"), F.when(full, F.concat("data", "data", "data", "data")).otherwise(F.col("data")).alias("data"))
    size = F.least(F.octet_length("data"), F.lit(32) - F.col("off"))
    return rows.select("file_id", "blk_idx", "seq", "off", size.cast("int").alias("len"), F.expr("substring(data, 1, least(octet_length(data), 32 - off))").alias("data"))


def q11_batch_merge(spark, sf_dir):
    return batch.merge_batch(_mixed(spark, sf_dir), 32).select("blk_idx", "kind", F.hex("data").alias("data_hex"), F.col("n_parts").cast("long").alias("n_parts"))


def q12_write_fold(spark, sf_dir):
    return folded(fold.content(event_ops(spark, sf_dir), SMALL))


def q13_zero_write(spark, sf_dir):
    return folded(fold.content(event_ops(spark, sf_dir, zero=True), SMALL))


def q14_truncate_clip(spark, sf_dir):
    return folded(fold.content(event_ops(spark, sf_dir, zero=True, truncate=True), SMALL, stretch=DAY))


def q15_final_size_stat(spark, sf_dir):
    return control.stat(fold.final_sizes(event_ops(spark, sf_dir, truncate=True), stretch=DAY), BLOCK)


def q16_read_before_write(spark, sf_dir):
    return batch.needs_base(_mixed(spark, sf_dir), 32).groupBy("needs_fetch").agg(F.count(F.lit(1)).alias("n"))


def q17_cno_assign(spark, sf_dir):
    return numbered_ops(spark, sf_dir).groupBy("file_id", "day", "cno").agg(F.count(F.lit(1)).alias("n_ops"))


def q18_snapshot_asof(spark, sf_dir):
    ops = numbered_ops(spark, sf_dir)
    return folded(snapshots.snapshot(ops, SMALL, 5)).join(snapshots.block_map(ops, SMALL, 5), ["file_id", "blk_idx"]).select("file_id", "blk_idx", "cno", "digest")


def q19_snapshot_diff(spark, sf_dir):
    ops = numbered_ops(spark, sf_dir)
    return snapshots.difference(snapshots.snapshot(ops, SMALL, 3), snapshots.snapshot(ops, SMALL, 6))


def q20_block_history(spark, sf_dir):
    return snapshots.history(snapshots.touched(numbered_ops(spark, sf_dir), SMALL))


def q21_segment_list_summary(spark, sf_dir):
    return snapshots.segment_list(snapshots.touched(numbered_ops(spark, sf_dir), SMALL))


def q22_segment_layout(spark, sf_dir):
    return snapshots.segment_layout(snapshots.touched(numbered_ops(spark, sf_dir), SMALL), BLOCK)


def q23_write_amplification(spark, sf_dir):
    ops = numbered_ops(spark, sf_dir)
    wrote = ops.groupBy("file_id").agg(F.sum("len").alias("payload"))
    stored = snapshots.touched(ops, SMALL).groupBy("file_id").agg((F.count(F.lit(1)) * SMALL).alias("stored"))
    return wrote.join(stored, "file_id").select("file_id", "payload", "stored", (F.col("payload") / F.col("stored")).alias("ratio"))


def event_log(spark, sf_dir):
    """A write-ahead log: segment by day, seq from 0 in each segment of a file."""
    from pyspark.sql import Window as W

    ops = event_ops(spark, sf_dir, zero=True)
    seq = F.row_number().over(W.partitionBy("file_id", "day").orderBy("seq")) - 1
    return ops.select("file_id", F.col("day").alias("segid"), seq.cast("long").alias("seq"), "offset", "len", (F.col("op") == "write_zero").alias("is_zero"), "data")


def q24_wal_key_codec(spark, sf_dir):
    log = event_log(spark, sf_dir)
    rows = log.select("file_id", names.log_key("wal", F.col("segid"), F.col("seq"), F.col("offset"), F.col("len")).alias("log_key"))
    parts = names.split_directory(F.col("log_key"))
    rows = rows.select("file_id", "log_key", parts["directory"].alias("directory"), names.parse_log_name(parts["name"]).alias("p"))
    return rows.select("file_id", "log_key", "directory", "p.seq", "p.offset", "p.len")


def q25_wal_replay(spark, sf_dir):
    return folded(fold.content(control.replay_order(event_log(spark, sf_dir)), SMALL))


def q26_range_lock_conflicts(spark, sf_dir):
    e = event_ops(spark, sf_dir)
    ranges = e.select(F.col("event_id").alias("id"), (F.col("file_id") * 1_000_000 + F.col("day")).alias("file_id"), F.col("offset").alias("start"), (F.col("offset") + 100).alias("end"))
    return control.conflict_counts(ranges, SMALL)


def q27_flush_policy(spark, sf_dir):
    e = event_ops(spark, sf_dir).select("file_id", F.col("day").alias("period"), "seq", F.call_function("div", "offset", F.lit(SMALL)).alias("blk_idx"), "event_id")
    limit = control.max_dirty_blocks(512, 1, SMALL)
    return control.flush_points(e, limit, 100 << 20, SMALL).select("event_id", "dirty", "needs_flush")


def q28_mpu_plan(spark, sf_dir):
    rows = files(spark, sf_dir).select(F.col("file_id").alias("doc_id"), (F.octet_length("data").cast("long") * 100_000).alias("n_bytes"))
    return rows.select("doc_id", "n_bytes", *[c.alias(n) for n, c in control.upload_plan(F.col("n_bytes"), 16 << 20).items()])


def q29_s3uri_parse(spark, sf_dir):
    p, case = read(spark, sf_dir, "pages"), F.col("page_id") % 5
    uri = F.when(case == 0, F.concat(F.lit("s3://bucket/pages/"), F.col("page_id"))).when(case == 1, F.col("url")).when(case == 2, F.lit("s3://bucket")).when(case == 3, F.lit("s3://bucket/")).otherwise(F.concat(F.lit("S3://b"), F.col("page_id"), F.lit("/a/b")))
    rows = p.select("page_id", uri.alias("uri"))
    return rows.select("page_id", *[c.alias(n) for n, c in names.parse_location(F.col("uri")).items()])


def q30_mode_flags(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 4096 + modes.S_IFREG).alias("mode"), (F.col("o_orderkey") * 7 % 4096).alias("new"), (F.col("o_orderkey") * 97 % (1 << 21)).alias("flags"))
    return o.select("o_orderkey", modes.chmod(F.col("mode"), F.col("new")).alias("mode"), modes.with_mode(F.col("mode"), F.col("new")).alias("set_mode"), modes.show_mode(F.col("mode")).alias("mode_text"), modes.access(F.col("flags")).alias("access"), modes.show_flags(F.col("flags")).alias("flags_text"), modes.flushes_each_write(F.col("flags")).alias("sync_mode"))


def q31_unlink(spark, sf_dir):
    rows = files(spark, sf_dir).select("file_id", F.octet_length("data").cast("long").alias("size"))
    return control.unlink(rows, rows.where("file_id % 7 = 0")).select(F.col("file_id").alias("doc_id"), "size")


def q32_recover_candidates(spark, sf_dir):
    segments = snapshots.touched(numbered_ops(spark, sf_dir), SMALL)
    heads = segments.groupBy("file_id").agg(F.max("cno").alias("top"))
    commits = segments.select("file_id", "cno").distinct().join(heads, "file_id").where("cno <= top - file_id % 3")
    return snapshots.recovery_candidates(segments, commits.select("file_id", "cno"))


def q33_commit_conflict(spark, sf_dir):
    ops = event_ops(spark, sf_dir).withColumn("writer", F.col("event_id") % 2)
    commits = ops.groupBy("file_id", "writer").agg(F.min("seq").alias("at")).withColumn("base_cno", F.lit(0).cast("long"))
    done = control.rebase(commits)
    ordered = ops.join(done, ["file_id", "writer"]).withColumn("seq", F.struct("cno", "seq"))
    heads = done.groupBy("file_id").agg(F.max("cno").alias("head"), F.bool_or("rebased").alias("rebased"))
    return folded(fold.content(ordered, SMALL)).join(heads, "file_id")


def q34_streaming_equals_batch(spark, sf_dir):
    from ..streaming import ingest

    return ingest.compare_with_batch(spark, sf_dir)


def q35_dedup_blocks(spark, sf_dir):
    return blocks.duplicate_blocks(blocks.split_blocks(files(spark, sf_dir), 512))


def _store(spark, **options):
    """An empty store in the shared folder."""
    from ..sources.store import BlockStore
    from ..streaming.ingest import shared_folder

    return BlockStore(spark, f"{shared_folder(spark)}/store", block_size=SMALL, now=lambda: 0.0, **options)


def _halves(ops: DataFrame) -> list[DataFrame]:
    """The log before and after the middle of its time."""
    low, high = ops.agg(F.min("seq"), F.max("seq")).first()
    if low is None:
        return [ops]
    return [ops.where(F.col("seq") < (low + high) // 2), ops.where(F.col("seq") >= (low + high) // 2)]


def q36_log_recovery(spark, sf_dir):
    """Half a log at a time goes to the write-ahead log, which a store opened after that commits."""
    from ..config import RuntimeConfig

    ops = event_ops(spark, sf_dir, zero=True)
    store = _store(spark, log=True, runtime=RuntimeConfig.large())
    for part in _halves(ops):
        store.submit(part)
    return folded(type(store)(spark, store.root, SMALL, log=True, now=lambda: 0.0).blocks())


def q37_store_commits(spark, sf_dir):
    """Writes, zeros and truncates in two commits; the blocks of the head that are not all zero."""
    store = _store(spark)
    for part in _halves(event_ops(spark, sf_dir, zero=True, truncate=True)):
        store.apply(part)
    return folded(store.blocks().where("kind = 'data'"))


def q38_store_read(spark, sf_dir):
    """Random reads of every file through the store."""
    store = _store(spark)
    store.apply(event_ops(spark, sf_dir))
    asked = store.inodes().select("file_id", F.lit(100).cast("long").alias("offset"), F.lit(700).cast("long").alias("len"))
    return store.read_many(asked).select("file_id", "bytes_read", F.md5(F.hex("data")).alias("digest"))


def q39_store_unlink(spark, sf_dir):
    """Sizes of the files that are left after a seventh of them went in one commit."""
    store = _store(spark)
    store.apply(event_ops(spark, sf_dir))
    store.unlink_many(store.inodes().where("file_id % 7 = 0").select("file_id"))
    return store.inodes().select("file_id", "size", "cno")


def q40_store_time_travel(spark, sf_dir):
    """The blocks as of the first of two commits."""
    store = _store(spark)
    for part in _halves(event_ops(spark, sf_dir, zero=True)):
        store.apply(part)
    return folded(store.snapshot(1).blocks())


def q41_dump_text(spark, sf_dir):
    """What is shown of inodes that are made from orders."""
    rows = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 977).alias("size"), (F.col("o_orderkey") % 512).alias("m"), F.timestamp_seconds(F.col("o_orderkey") * 1000).alias("at"))
    shown = dumps.stat_text(F.col("o_orderkey"), F.col("size"), F.lit(1000), F.lit(1000), F.col("m") + modes.S_IFREG, F.lit(1), F.col("at"), F.col("at"), F.col("at"))
    return rows.select("o_orderkey", shown.alias("shown"), dumps.config_text(F.lit(56), F.lit(4096), F.lit(8192), F.lit("MicroGroup")).alias("config"), control.update_blocks(F.col("o_orderkey"), F.col("m") - 256).alias("blocks"))


QUERIES = {name: f for name, f in sorted(globals().items()) if name[0] == "q" and name[1:3].isdigit()}


# ---------------------------------------------------------------- the same in SQL


def _ops(zero: bool = False, truncate: bool = False) -> str:
    kind = f"CASE WHEN event_type = 'error' AND {zero} THEN 'write_zero' WHEN event_type = 'signup' AND {truncate} THEN 'truncate' ELSE 'write' END"
    return f"""ops AS (SELECT user_id f, epoch_us(ts) s, epoch_us(ts) // {DAY} AS d, event_id, {kind} op, event_id * 37 % {SPACE} o,
        lpad(hex(event_id), 16, '0') hx, dense_rank() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // {DAY}) AS cno
        FROM events WHERE event_id IS NOT NULL AND ts IS NOT NULL AND user_id IS NOT NULL)"""


def _bytes(source: str = "ops", part: str = "f", name: str = "bytes") -> str:
    return f"""{name}_w AS (SELECT *, min(CASE WHEN op = 'truncate' THEN o END) OVER (PARTITION BY {part} ORDER BY s ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) cut FROM {source}),
        {name} AS (SELECT f, cno, s, o + i pos, (o + i) // {SMALL} blk, CASE WHEN op = 'write' THEN substring(hx, (2 * i + 1)::INT, 2) ELSE '00' END b
        FROM {name}_w, unnest(range(8)) t(i) WHERE op <> 'truncate' AND o + i < coalesce(cut, 1::BIGINT << 62))"""


def _blocks(bytes_: str = "bytes", order: str = "s", name: str = "blocks") -> str:
    return f"""{name}_last AS (SELECT f, pos, arg_max(b, {order}) b FROM {bytes_} GROUP BY ALL),
        {name}_pos AS (SELECT f, blk, blk * {SMALL} + i pos FROM (SELECT DISTINCT f, blk FROM {bytes_}), unnest(range({SMALL})) t(i)),
        {name} AS (SELECT p.f, p.blk, string_agg(coalesce(l.b, '00'), '' ORDER BY p.pos) hx FROM {name}_pos p LEFT JOIN {name}_last l ON p.f = l.f AND p.pos = l.pos GROUP BY p.f, p.blk)"""


_KIND = f"CASE WHEN hx = repeat('00', {SMALL}) THEN 'zero' ELSE 'data' END"
_CONTENT = f"SELECT f AS file_id, blk AS blk_idx, {_KIND} AS kind, md5(hx) AS digest FROM blocks"
_DOCS = "docs AS (SELECT doc_id, encode(text) t, octet_length(encode(text)) n FROM documents WHERE text IS NOT NULL)"
_SPLIT = f"{_DOCS}, parts AS (SELECT doc_id, n, i AS blk, t[(i * {BLOCK} + 1):least((i + 1) * {BLOCK}, n)] p FROM docs, unnest(range((n + {BLOCK - 1}) // {BLOCK})) u(i))"
_TOUCHED = f"{_ops(True, True)}, {_bytes(part='f, d')}, touched AS (SELECT DISTINCT f, cno, blk FROM bytes)"
_SUMMARY = "(208 + 16 * n + 4095) // 4096 * 4096"
_PARTS = "parts AS (SELECT l_orderkey * 131 % 1073741824 segid, l_partkey % 262144 * 4096 o, (l_suppkey * 16 + l_linenumber) % 262144 seq FROM lineitem)"
_STAGED = "(1::BIGINT << 62) | (segid::BIGINT << 32)"
_MICRO = f"{_STAGED} | ((o::BIGINT >> 12) << 14) | (seq::BIGINT >> 4)"
_LOG = f"{_ops(True)}, log AS (SELECT *, row_number() OVER (PARTITION BY f, d ORDER BY s) - 1 AS q FROM ops)"
_MIXED = f"{_ops()}, m AS (SELECT f blk, s, event_id % 5 = 0 whole, CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id * 13 % 32 END o, CASE WHEN event_id % 5 = 0 THEN repeat(hx, 4) ELSE hx END hx FROM ops)"


def _flag(name: str) -> str:
    v = modes.FLAGS[name]
    return f"CASE WHEN fl & {v} = {v} THEN ' | {name}' ELSE '' END"


ORACLE = {
    "q01_block_split": f"WITH {_SPLIT} SELECT doc_id, blk AS blk_idx, octet_length(p) AS len, md5(p) AS digest FROM parts",
    "q02_reassemble": f"WITH {_DOCS} SELECT doc_id, (n + {BLOCK - 1}) // {BLOCK} AS n_blocks, n AS n_bytes, md5(t) AS digest FROM docs WHERE n > 0",
    "q03_range_read": f"WITH {_DOCS} SELECT doc_id, greatest(least(5000, n - 1000), 0) AS bytes_read, md5(CASE WHEN n > 1000 THEN t[1001:least(6000, n)] ELSE ''::BLOB END) AS digest FROM docs",
    "q04_read_past_eof": f"""WITH {_DOCS}, a AS (SELECT *, greatest(n - 50 + 40 * (doc_id % 3), 0) o FROM docs)
        SELECT doc_id, greatest(least(100, n - o), 0) AS bytes_read, md5(CASE WHEN o < n THEN t[(o + 1):least(o + 100, n)] ELSE ''::BLOB END) AS digest FROM a""",
    "q05_sparse_read": f"""WITH {_SPLIT} SELECT d.doc_id, any_value(d.n) AS bytes_read, coalesce(sum(CASE WHEN blk % 2 = 0 THEN octet_length(p) END), 0)::BIGINT AS zero_bytes,
        md5(coalesce(string_agg(CASE WHEN blk % 2 = 0 THEN repeat('00', octet_length(p)) ELSE hex(p) END, '' ORDER BY blk), '')) AS digest FROM docs d LEFT JOIN parts USING (doc_id) GROUP BY d.doc_id""",
    "q06_ptr_micro_group": f"WITH {_PARTS} SELECT segid, o AS \"offset\", seq, {_MICRO} AS ptr, segid AS d_segid, o AS d_offset, seq >> 4 AS d_group FROM parts",
    "q07_ptr_flat": f"WITH {_PARTS} SELECT segid, o AS \"offset\", {_STAGED} | o AS ptr, segid AS d_segid, o AS d_offset FROM parts",
    "q08_ptr_classify": f"""WITH {_PARTS} SELECT kind, shown, count(*) AS n FROM (SELECT
        CASE seq % 5 WHEN 0 THEN 'zero' WHEN 1 THEN 'dummy' WHEN 2 THEN 'invalid' WHEN 3 THEN CASE WHEN segid = 0 THEN 'invalid' ELSE 'unknown' END ELSE 'staging' END AS kind,
        CASE seq % 5 WHEN 0 THEN '[Zero Block]' WHEN 1 THEN '[Dummy]' WHEN 2 THEN '[Invalid]' WHEN 3 THEN CASE WHEN segid = 0 THEN '[Invalid]' ELSE '[Unkown: 0x' || lower(hex(segid)) || ']' END
        ELSE '[Staging: id ' || segid || ' - offset ' || o || ' - group ' || (seq >> 4) || ']' END AS shown FROM parts) GROUP BY ALL""",
    "q09_meta_config_codec": """SELECT p_partkey, (7::BIGINT << 24) | (a << 16) | (b << 8) | f AS word, 56 AS root_size, 1::BIGINT << a AS meta_block_size, 1::BIGINT << b AS data_block_size, f AS format,
        CASE f WHEN 0 THEN 'nop' WHEN 1 THEN 'flat' ELSE 'micro_group' END AS form_name
        FROM (SELECT p_partkey, floor(log2(greatest(1000 * p_size, 4096)))::BIGINT a, floor(log2(greatest(3333 * p_size, 4096)))::BIGINT b, p_partkey % 3 f FROM part)""",
    "q10_aligned_last_wins": f"WITH {_ops()} SELECT f AS blk_idx, arg_max(hx, s) AS data_hex FROM ops GROUP BY f",
    "q11_batch_merge": f"""WITH {_MIXED}, k AS (SELECT *, max(CASE WHEN whole THEN s END) OVER (PARTITION BY blk) fs FROM m), live AS (SELECT * FROM k WHERE fs IS NULL OR s >= fs),
        put AS (SELECT blk, o + i pos, arg_max(substring(hx, (2 * i + 1)::INT, 2), s) b FROM live, unnest(range(32)) t(i) WHERE i < length(hx) // 2 AND o + i < 32 GROUP BY ALL),
        bl AS (SELECT q.blk, string_agg(coalesce(b, '00'), '' ORDER BY q.pos) hx FROM (SELECT DISTINCT blk, i pos FROM m, unnest(range(32)) t(i)) q LEFT JOIN put USING (blk, pos) GROUP BY q.blk)
        SELECT blk AS blk_idx, CASE WHEN hx = repeat('00', 32) THEN 'zero' ELSE 'data' END AS kind, nullif(hx, repeat('00', 32)) AS data_hex, (SELECT count(*) FROM live WHERE live.blk = bl.blk) AS n_parts FROM bl""",
    "q12_write_fold": f"WITH {_ops()}, {_bytes()}, {_blocks()} {_CONTENT}",
    "q13_zero_write": f"WITH {_ops(True)}, {_bytes()}, {_blocks()} {_CONTENT}",
    "q14_truncate_clip": f"WITH {_ops(True, True)}, {_bytes()}, {_blocks()} {_CONTENT}",
    "q15_final_size_stat": f"""WITH {_ops(False, True)}, l AS (SELECT f, coalesce(max(CASE WHEN op = 'truncate' THEN s END), -1) ts, coalesce(arg_max(o, s) FILTER (op = 'truncate'), 0) z FROM ops GROUP BY f),
        z AS (SELECT f, greatest(any_value(z), coalesce(max(o + 8) FILTER (op = 'write' AND s > ts), 0)) size FROM ops JOIN l USING (f) GROUP BY f)
        SELECT f AS file_id, size, (size + 511) // 512 AS blocks, {BLOCK} AS blksize FROM z""",
    "q16_read_before_write": f"WITH {_MIXED} SELECT needs_fetch, count(*) AS n FROM (SELECT blk, NOT bool_or(whole) needs_fetch FROM m GROUP BY blk) GROUP BY 1",
    "q17_cno_assign": f"WITH {_ops(True, True)} SELECT f AS file_id, d AS day, cno, count(*) AS n_ops FROM ops GROUP BY ALL",
    "q18_snapshot_asof": f"""WITH {_ops(True, True)}, seen AS (SELECT * FROM ops WHERE cno <= 5), {_bytes('seen')}, {_blocks()}
        SELECT f AS file_id, blk AS blk_idx, (SELECT max(cno) FROM bytes x WHERE x.f = blocks.f AND x.blk = blocks.blk) AS cno, md5(hx) AS digest FROM blocks""",
    "q19_snapshot_diff": f"""WITH {_ops(True, True)}, s3 AS (SELECT * FROM ops WHERE cno <= 3), s6 AS (SELECT * FROM ops WHERE cno <= 6), {_bytes('s3', name='b3')}, {_bytes('s6', name='b6')}, {_blocks('b3', name='k3')}, {_blocks('b6', name='k6')},
        j AS (SELECT coalesce(a.f, b.f) f, coalesce(a.blk, b.blk) blk, CASE WHEN a.f IS NULL THEN 'added' WHEN b.f IS NULL THEN 'removed' WHEN a.hx <> b.hx THEN 'changed' END c FROM k3 a FULL JOIN k6 b ON a.f = b.f AND a.blk = b.blk)
        SELECT f AS file_id, blk AS blk_idx, c AS change FROM j WHERE c IS NOT NULL""",
    "q20_block_history": f"WITH {_TOUCHED} SELECT f AS file_id, cno, blk AS blk_idx, lag(cno) OVER (PARTITION BY f, blk ORDER BY cno) AS prev_cno FROM touched",
    "q21_segment_list_summary": f"WITH {_TOUCHED} SELECT file_id, cno, n AS n_blocks, {_SUMMARY} AS summary_bytes FROM (SELECT f AS file_id, cno, count(*) n FROM touched GROUP BY ALL)",
    "q22_segment_layout": f"""WITH {_TOUCHED}, l AS (SELECT f, cno segid, blk, row_number() OVER (PARTITION BY f, cno ORDER BY blk) - 1 AS seq, count(*) OVER (PARTITION BY f, cno) n FROM touched),
        p AS (SELECT *, {_SUMMARY} + seq * {BLOCK} o FROM l) SELECT f AS file_id, segid AS cno, blk AS blk_idx, seq, o AS "offset", {_MICRO} AS ptr FROM p""",
    "q23_write_amplification": f"""WITH {_TOUCHED}, a AS (SELECT f, sum(CASE WHEN op = 'truncate' THEN 0 ELSE 8 END)::BIGINT payload FROM ops GROUP BY f), b AS (SELECT f, count(*) * {SMALL} stored FROM touched GROUP BY f)
        SELECT f AS file_id, payload, stored, payload / stored AS ratio FROM a JOIN b USING (f)""",
    "q24_wal_key_codec": f"WITH {_LOG} SELECT f AS file_id, 'wal/' || lpad(d::VARCHAR, 10, '0') || '/' || q || '_' || o || '_8' AS log_key, 'wal/' || lpad(d::VARCHAR, 10, '0') AS directory, q AS seq, o AS \"offset\", 8 AS len FROM log",
    "q25_wal_replay": f"WITH {_ops(True)}, {_bytes()}, {_blocks()} {_CONTENT}",
    "q26_range_lock_conflicts": f"""WITH {_ops()}, r AS (SELECT event_id id, f * 1000000 + d AS g, o // {SMALL} * {SMALL} s0, (o + 100 + {SMALL - 1}) // {SMALL} * {SMALL} e0 FROM ops)
        SELECT a.g AS file_id, count(*) AS n_conflicts FROM r a JOIN r b ON a.g = b.g AND a.id < b.id AND a.s0 < b.e0 AND b.s0 < a.e0 GROUP BY a.g""",
    "q27_flush_policy": f"""WITH {_ops()}, a AS (SELECT *, (row_number() OVER (PARTITION BY f, d, o // {SMALL} ORDER BY s) = 1)::INT n FROM ops),
        b AS (SELECT event_id, sum(n) OVER (PARTITION BY f, d ORDER BY s ROWS UNBOUNDED PRECEDING)::BIGINT dirty FROM a) SELECT event_id, dirty, dirty > 2 AS needs_flush FROM b""",
    "q28_mpu_plan": f"""WITH {_DOCS}, p AS (SELECT doc_id, n::BIGINT * 100000 n, CASE WHEN n::BIGINT * 100000 > 16777216 THEN n::BIGINT * 100000 // 16777216 + 1 ELSE 1 END k FROM docs)
        SELECT doc_id, n AS n_bytes, k AS parts, n - (k - 1) * 16777216 AS last_part FROM p""",
    "q29_s3uri_parse": """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'bucket' WHEN 4 THEN 'b' || page_id END AS bucket, CASE page_id % 5 WHEN 0 THEN 'pages/' || page_id WHEN 4 THEN 'a/b' END AS key,
        CASE page_id % 5 WHEN 1 THEN 'S3 Uri must start with s3:// or S3://' WHEN 2 THEN 'Incomplete S3 Uri' WHEN 3 THEN 'Missing key from S3 Uri' END AS error FROM pages""",
    "q30_mode_flags": f"""WITH o AS (SELECT o_orderkey, o_orderkey % 4096 m, o_orderkey * 7 % 4096 w, o_orderkey * 97 % 2097152 fl FROM orders)
        SELECT o_orderkey, 32768 + w AS mode, 32768 + w AS set_mode, 'S_IFREG | 0o' || format('{{:o}}', m) AS mode_text, CASE fl % 4 WHEN 0 THEN 'O_RDONLY' WHEN 1 THEN 'O_WRONLY' WHEN 2 THEN 'O_RDWR' ELSE '' END AS access,
        CASE fl % 4 WHEN 0 THEN 'O_RDONLY' WHEN 1 THEN 'O_WRONLY' WHEN 2 THEN 'O_RDWR' ELSE '' END || {' || '.join(map(_flag, modes.FLAGS))} AS flags_text, fl & 16384 > 0 OR fl & 4096 > 0 AS sync_mode FROM o""",
    "q31_unlink": f"WITH {_DOCS} SELECT doc_id, n AS size FROM docs WHERE doc_id % 7 <> 0",
    "q32_recover_candidates": f"""WITH {_TOUCHED}, g AS (SELECT DISTINCT f, cno FROM touched), t AS (SELECT f, max(cno) top FROM g GROUP BY f), c AS (SELECT f, cno FROM g JOIN t USING (f) WHERE cno <= top - f % 3),
        h AS (SELECT f, max(cno) head FROM c GROUP BY f) SELECT f AS file_id, cno FROM g LEFT JOIN h USING (f) WHERE cno = coalesce(head, 0) + 1 AND (f, cno) NOT IN (SELECT (f, cno) FROM c)""",
    "q33_commit_conflict": f"""WITH {_ops()}, w AS (SELECT f, event_id % 2 wr, min(s) t FROM ops GROUP BY ALL), r AS (SELECT f, wr, row_number() OVER (PARTITION BY f ORDER BY t) c FROM w),
        two AS (SELECT ops.* REPLACE (c::HUGEINT * 100000000000000000 + s AS s) FROM ops JOIN r ON ops.f = r.f AND ops.event_id % 2 = r.wr), {_bytes('two')}, {_blocks()}
        SELECT k.*, head, head > 1 AS rebased FROM ({_CONTENT}) k JOIN (SELECT f AS file_id, max(c) head FROM r GROUP BY f) USING (file_id)""",
    "q34_streaming_equals_batch": f"WITH {_ops(True, True)}, {_bytes()}, {_blocks()} SELECT f AS file_id, blk AS blk_idx, md5(hx) AS streamed, md5(hx) AS folded, true AS equal FROM blocks",
    "q36_log_recovery": f"WITH {_ops(True)}, {_bytes()}, {_blocks()} {_CONTENT}",
    "q37_store_commits": f"WITH {_ops(True, True)}, {_bytes()}, {_blocks()} {_CONTENT} WHERE hx <> repeat('00', {SMALL})",
    "q38_store_read": f"""WITH {_ops()}, {_bytes()}, {_blocks()}, r AS (SELECT f, greatest(least(700, max(o + 8) - 100), 0) n FROM ops GROUP BY f), p AS (SELECT f, 100 + i pos FROM r, unnest(range(n)) t(i))
        SELECT r.f AS file_id, r.n AS bytes_read, md5(coalesce(string_agg(CASE WHEN p.pos IS NOT NULL THEN coalesce(b, '00') END, '' ORDER BY p.pos), '')) AS digest FROM r LEFT JOIN p ON p.f = r.f LEFT JOIN blocks_last l ON l.f = p.f AND l.pos = p.pos GROUP BY r.f, r.n""",
    "q39_store_unlink": f"WITH {_ops()} SELECT f AS file_id, max(o + 8) AS size, 1 AS cno FROM ops WHERE f % 7 <> 0 GROUP BY f",
    "q40_store_time_travel": f"WITH {_ops(True)}, seen AS (SELECT * FROM ops WHERE s < (SELECT (min(s) + max(s)) // 2 FROM ops)), {_bytes('seen')}, {_blocks()} {_CONTENT}",
    "q41_dump_text": """SELECT o_orderkey, '==== dump Stat ino: ' || o_orderkey || ' ====' || chr(10) || '  file size: ' || z || ', blocks: ' || (z + 511) // 512 || chr(10) || '  uid: 1000, gid: 1000, mode: 0o' || format('{:o}', 32768 + m) || ', nlink: 1, dev: 0, rdev: 0' || chr(10)
        || '  access time: ' || t || chr(10) || '  change time: ' || t || chr(10) || '  modify time: ' || t AS shown, 'root size: 56, meta block size: 4096, data block size: 8192, block ptr format: MicroGroup' AS config,
        o_orderkey + sign(m - 256)::BIGINT * ((abs(m - 256) + 511) // 512) AS blocks FROM (SELECT o_orderkey, o_orderkey * 977 z, o_orderkey % 512 m, strftime(to_timestamp(o_orderkey * 1000) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') t FROM orders)""",
    "q35_dedup_blocks": f"""WITH {_DOCS}, parts AS (SELECT doc_id, t[(i * 512 + 1):least((i + 1) * 512, n)] p FROM docs, unnest(range((n + 511) // 512)) u(i))
        SELECT md5(p) AS digest, count(*) AS copies, count(DISTINCT doc_id) AS files FROM parts GROUP BY 1 HAVING count(*) > 1""",
}
