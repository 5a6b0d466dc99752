"""A store of versioned files: append-only Parquet tables and a commit log.

Layout below the root, all on the cluster's own file system:

    data/<attempt>/segments     file_id, blk_idx, kind, data
    data/<attempt>/truncations  file_id, from_blk
    data/<attempt>/inodes       file_id, size, mode, uid, gid, nlink, deleted, atime, mtime, ctime
    commits/<cno, ten digits>   JSON and a line feed: attempt, base, token, at (seconds)
    attrs/<cno>-<seq>           JSON and a line feed: file_id, fields
    wal/segid=<cno>             operations that no commit holds yet (sources/wal.py)

A record is made by exclusive creation and is valid once its line feed is there;
a commit's record is what makes an attempt visible. Object stores need a
conditional put in its place. A writer that finds its number taken reads the new
head and folds its operations over that. A record that its writer never
finished is put aside after a while. Attributes alone make no commit: their
records belong to the commit they came after. Readers see the head, or the
state as of any commit. Records never change, so each is read once a session.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from ..config import RuntimeConfig
from ..functions import modes
from ..functions.addressing import block_ranges
from ..operators import batch, control, fold
from ..operators import blocks as B
from .wal import WriteAheadLog

SEGMENTS = StructType([StructField("file_id", LongType()), StructField("blk_idx", LongType()), StructField("kind", StringType()), StructField("data", BinaryType())])
TRUNCATIONS = StructType([StructField("file_id", LongType()), StructField("from_blk", LongType())])
INODES = StructType([StructField("file_id", LongType()), StructField("size", LongType()), StructField("mode", LongType()), StructField("uid", LongType()), StructField("gid", LongType()), StructField("nlink", LongType()), StructField("deleted", BooleanType()), StructField("atime", DoubleType()), StructField("mtime", DoubleType()), StructField("ctime", DoubleType())])
OPS = StructType([StructField("file_id", LongType()), StructField("seq", LongType()), StructField("op", StringType()), StructField("offset", LongType()), StructField("len", LongType()), StructField("data", BinaryType())])
#: Fixed values of retries: how often, and the seconds added to the wait each time.
RETRIES, BACKOFF = 3, 1.0
#: Seconds after which a finished attempt without a commit is adopted.
ADOPT_AFTER = 5.0
#: So many records are read in one job.
MANY = 32


class Conflict(Exception):
    """The commit number was taken by another writer, on every try."""


class Busy(Exception):
    """The log still holds operations on a file that is to be created."""


class ReadOnly(Exception):
    """A snapshot was asked to change."""


class BlockStore:
    """log: operations can be submitted to a write-ahead log and are committed by a policy.

    What the log holds and no commit does is committed when such a store is opened.
    """

    def __init__(self, spark: SparkSession, root: str, block_size: int = 4096, cno: int | None = None, on_commit: Callable | None = None, on_unlink: Callable | None = None, sleep: Callable = time.sleep, log: bool = False, runtime: RuntimeConfig | None = None, now: Callable[[], float] = time.time):
        self.spark, self.root, self.block_size, self.cno = spark, root.rstrip("/"), block_size, cno
        self.on_commit, self.on_unlink, self.sleep, self.now = on_commit, on_unlink, sleep, now
        self.runtime = runtime or RuntimeConfig()
        self._records: dict[str, dict] = {}
        self._read_at: dict[int, float] = {}
        self._dirty, self._dirty_bytes, self._flushed = 0, 0, now()
        self.wal = WriteAheadLog(spark, f"{self.root}/wal") if log else None
        if self.wal and cno is None:
            self.flush()

    # -- the commit log

    def _fs(self, path: str):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _list(self, folder: str) -> list[str]:
        fs, at = self._fs(f"{self.root}/{folder}")
        return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []

    def _read(self, path: str) -> str:
        fs, at = self._fs(path)
        stream = fs.open(at)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _create(self, path: str, text: str) -> bool:
        """Writes a record that must not exist yet; False if it does.

        A record without its line feed that is older than ADOPT_AFTER belongs
        to a writer that died; it is put aside, which one writer can do only,
        and the record is made again. Whoever was only slow finds another text.
        """
        fs, at = self._fs(path)
        try:
            out = fs.create(at, False)
        except Exception as e:
            if "FileAlreadyExists" not in str(e) and "already exists" not in str(e):
                raise
            if not self._abandoned(path):
                return False
            fs.rename(at, self._fs(f"{path}.{uuid.uuid4().hex}.dead")[1])
            return self._create(path, text)
        out.write(bytearray(f"{text}\n".encode()))
        out.close()
        return self._read(path) == f"{text}\n"

    def _abandoned(self, path: str) -> bool:
        fs, at = self._fs(path)
        return not self._read(path).endswith("\n") and self.now() - fs.getFileStatus(at).getModificationTime() / 1000 >= ADOPT_AFTER

    def _load(self, paths: list[str]) -> None:
        """Reads records that are not known yet; many in one job."""
        missing = [p for p in paths if p not in self._records]
        if len(missing) > MANY:
            rows = self.spark.read.text(missing, wholetext=True, lineSep=None).select("value", F.input_file_name().alias("p")).collect()
            texts = {r.p.rsplit("/", 1)[1]: r.value for r in rows}
            found = [(p, texts.get(p.rsplit("/", 1)[1], "")) for p in missing]
        else:
            found = [(p, self._read(p)) for p in missing]
        self._records |= {p: json.loads(text) for p, text in found if text.endswith("\n")}

    def commits(self) -> list[int]:
        """Numbers of the visible commits, up to the snapshot's. Only the last record may be unfinished."""
        found = [int(x) for x in self._list("commits") if x.isdigit()]
        if found:
            self._load([self._path(found[-1])])
            found = found if self._path(found[-1]) in self._records else found[:-1]
        return [n for n in found if self.cno is None or n <= self.cno]

    def _path(self, cno: int) -> str:
        return f"{self.root}/commits/{cno:010d}"

    def record(self, cno: int) -> dict:
        self._load([self._path(cno)])
        return self._records[self._path(cno)]

    def records(self) -> dict[int, dict]:
        """The records of all visible commits."""
        numbers = self.commits()
        self._load([self._path(n) for n in numbers])
        return {n: self._records[self._path(n)] for n in numbers}

    def last_cno(self) -> int:
        return max(self.commits(), default=0)

    def snapshot(self, cno: int) -> BlockStore:
        """The store as of a commit; it cannot be changed."""
        out = BlockStore(self.spark, self.root, self.block_size, cno)
        out._records = self._records
        return out

    def exists(self, name: str = "") -> bool:
        """Whether there is an object of this name below the root."""
        fs, at = self._fs(f"{self.root}/{name}")
        return fs.exists(at)

    def objects(self, prefix: str = "") -> DataFrame:
        """path, bytes and modified of all files below a folder, listed by the cluster."""
        pattern = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{self.root}/{prefix}")
        return pattern.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))

    # -- the tables

    def table(self, name: str, schema: StructType) -> DataFrame:
        """All rows of a table up to the head, with cno. One scan over the attempts' folders."""
        attempts = {r["attempt"]: n for n, r in self.records().items()}
        paths = [f"{self.root}/data/{a}/{name}" for a in attempts]
        if not paths:
            return self.spark.createDataFrame([], StructType([*schema.fields, StructField("cno", LongType())]))
        named = self.spark.createDataFrame(list(attempts.items()), "bw_attempt string, cno long")
        rows = self.spark.read.schema(schema).parquet(*paths).withColumn("bw_attempt", F.regexp_extract(F.col("_metadata.file_path"), rf"/data/([^/]+)/{name}/", 1))
        return rows.join(F.broadcast(named), "bw_attempt").drop("bw_attempt")

    def attributes(self) -> list[dict]:
        """The attribute records up to the head, in order."""
        names = [x for x in self._list("attrs") if len(x) == 21 and (self.cno is None or int(x[:10]) <= self.cno)]
        paths = [f"{self.root}/attrs/{x}" for x in names]
        self._load(paths)
        return [self._records[p] | {"cno": int(x[:10])} for p, x in zip(paths, names) if p in self._records]

    def inodes(self, where: Column | None = None) -> DataFrame:
        """The latest inode of every file that is not unlinked. where narrows the files and reaches the scan."""
        rows = self.table("inodes", INODES)
        rows = rows if where is None else rows.where(where)
        latest = rows.groupBy("file_id").agg(F.max_by(F.struct(*[f.name for f in INODES.fields[1:]], "cno"), "cno").alias("i"))
        latest = latest.select("file_id", "i.*").where("NOT deleted")
        newer: dict[tuple[int, str], tuple[int, float]] = {}
        for r in self.attributes():
            newer |= {(r["file_id"], k): (r["cno"], v) for k, v in r["fields"].items()}
        if not newer:
            return latest
        fields = sorted({k for _, k in newer})
        set_ = {}
        for (f, k), (n, v) in newer.items():
            set_.setdefault(f, {})[k] = (n, float(v))
        rows = [(f, *[x for k in fields for x in own.get(k, (None, None))]) for f, own in set_.items()]
        table = self.spark.createDataFrame(rows, "file_id long, " + ", ".join(f"bw_{k}_cno long, bw_{k} double" for k in fields))
        joined = latest.join(table, "file_id", "left")
        # a record counts if no later commit has written the inode again
        values = {k: F.when(F.col(f"bw_{k}_cno") >= F.col("cno"), F.col(f"bw_{k}").cast(INODES[k].dataType)).otherwise(F.col(k)) for k in fields}
        return joined.select(*[values.get(c, F.col(c)).alias(c) for c in latest.columns])

    def versions(self, where: Column | None = None, keys: DataFrame | None = None) -> DataFrame:
        """file_id, blk_idx, kind, cno: the newest version of every block that no later truncate removed. No payload is read.

        where narrows the blocks and reaches the scan; keys (file_id, blk_idx)
        are the blocks that are asked for.
        """
        rows, cuts = self.table("segments", SEGMENTS).select("file_id", "blk_idx", "kind", "cno"), self.table("truncations", TRUNCATIONS)
        if where is not None:
            rows = rows.where(where)
        if keys is not None:
            rows = rows.join(keys.select("file_id", "blk_idx").distinct(), ["file_id", "blk_idx"], "left_semi")
        newest = rows.groupBy("file_id", "blk_idx").agg(F.max("cno").alias("cno"), F.max_by("kind", "cno").alias("kind"))
        cuts = cuts.select("file_id", "from_blk", F.col("cno").alias("cut_cno"))
        # a cut at the same commit came with that commit's own clipped writes
        gone = (newest["file_id"] == cuts["file_id"]) & (newest["blk_idx"] >= cuts["from_blk"]) & (newest["cno"] < cuts["cut_cno"])
        return newest.join(cuts, gone, "left_anti").select("file_id", "blk_idx", "kind", "cno")

    def blocks(self, where: Column | None = None, keys: DataFrame | None = None) -> DataFrame:
        """versions() with data, which is fetched last, for the versions that stand."""
        rows = self.table("segments", SEGMENTS).select("file_id", "blk_idx", "cno", "data")
        rows = rows if where is None else rows.where(where)
        own = ["file_id", "blk_idx", "cno"]
        return self.versions(where, keys).join(rows, own).select("file_id", "blk_idx", "kind", "data", "cno")

    def segments(self) -> DataFrame:
        """cno, file_id, n_blocks of every commit."""
        return self.table("segments", SEGMENTS).groupBy("cno", "file_id").agg(F.count(F.lit(1)).alias("n_blocks"))

    def segment(self, cno: int) -> DataFrame:
        """The block map that one commit wrote."""
        return self.table("segments", SEGMENTS).where(F.col("cno") == cno).select("file_id", "blk_idx", "kind")

    # -- reading

    def read_many(self, requests: DataFrame) -> DataFrame:
        """Range reads of many files: requests (file_id, offset, len). Only blocks that they touch are looked at."""
        self.settle()
        keys = requests.where("len > 0").select("file_id", F.inline(block_ranges(F.col("offset"), F.col("len"), self.block_size)))
        return B.read_ranges(requests, self.inodes(), self.blocks(keys=keys).where("kind = 'data'"), self.block_size)

    def read(self, file_id: int, offset: int, length: int) -> bytes:
        """Up to length bytes; fewer at the end of the file, none beyond it. File and blocks are filters of the scans."""
        self.settle()
        own = F.col("file_id") == file_id
        ask = self.spark.createDataFrame([(file_id, offset, length)], "file_id long, offset long, len long")
        blocks = self.blocks(own & F.col("blk_idx").between(offset // self.block_size, (offset + max(length, 1) - 1) // self.block_size))
        row = B.read_ranges(ask, self.inodes(own), blocks.where("kind = 'data'"), self.block_size).first()
        if row is None:
            raise FileNotFoundError(file_id)
        self._read_at[file_id] = self.now()
        return bytes(row["data"])

    def stat(self, file_id: int) -> dict:
        self.settle()
        row = control.stat(self.inodes(F.col("file_id") == file_id), self.block_size).first()
        if row is None:
            raise FileNotFoundError(file_id)
        out = row.asDict()
        out["atime"] = max(out["atime"] or 0.0, self._read_at.get(file_id, 0.0))
        return out

    # -- committing

    def _commit(self, base: int, token: str, write: Callable[[str], None]) -> int | None:
        attempt = f"{base + 1:010d}-{uuid.uuid4().hex}"
        write(f"{self.root}/data/{attempt}")
        done = json.dumps({"attempt": attempt, "base": base, "token": token, "at": self.now()})
        self._create(f"{self.root}/data/{attempt}/_done", done)
        return base + 1 if self._create(self._path(base + 1), done) else None

    def _finish(self, number: int) -> int:
        if self.on_commit:
            try:
                self.on_commit(number)
            except Exception as e:  # hooks never undo a commit
                print(f"on_commit hook failed: {e}")
        return number

    def _retry(self, token: str, write: Callable[[int, str], None]) -> int:
        if self.cno is not None:
            raise ReadOnly(self.root)
        for k in range(RETRIES + 1):
            base = self.last_cno()
            number = self._commit(base, token, lambda at, base=base: write(base, at))
            if number is not None:
                return self._finish(number)
            if k < RETRIES:
                self.sleep(BACKOFF * (k + 1))
        raise Conflict(self.root)

    def done_by(self, token: str) -> int | None:
        """The commit that carries a token."""
        return next((n for n, r in reversed(self.records().items()) if r["token"] == token), None)

    def heads(self) -> DataFrame:
        """file_id, head: the last commit that wrote a file's inode, unlinked files too."""
        return self.table("inodes", INODES).groupBy("file_id").agg(F.max("cno").alias("head"))

    def settle(self) -> None:
        """Commits what this store has logged, so that reads see it and later operations come after it."""
        if self.wal and self._dirty:
            self.flush()

    def apply(self, ops: DataFrame, token: str | None = None) -> int | None:
        """Folds operations on any number of files over the head and commits the result.

        Files that do not exist come into being. A token that has been
        committed before makes this a no-op that returns its commit; nothing
        to do commits nothing and returns None. What was logged comes first.
        """
        self.settle()
        return self._apply(ops, token)

    def _apply(self, ops: DataFrame, token: str | None = None) -> int | None:
        if token and (before := self.done_by(token)) is not None:
            return before
        ops = ops.select(*[f.name for f in OPS.fields]).where("op <> 'flush'")
        if ops.isEmpty():
            return None

        def write(base: int, at: str) -> None:
            head, at_ = self.snapshot(base), float(self.now())
            # the size a file had before counts as a truncate to it ahead of the log
            old = head.inodes()
            low = F.lit(-(1 << 62)).cast("long")
            seeds = old.join(ops.select("file_id").distinct(), "file_id", "left_semi").select("file_id", low.alias("seq"), F.lit("truncate").alias("op"), F.col("size").alias("offset"), F.lit(0).cast("long").alias("len"), F.lit(None).cast("binary").alias("data"))
            full = ops.unionByName(seeds)
            sizes = fold.final_sizes(full)
            cuts = ops.where("op = 'truncate'").groupBy("file_id").agg(F.min("offset").alias("cut"))
            least = cuts.select("file_id", F.call_function("div", F.col("cut") + self.block_size - 1, F.lit(self.block_size)).alias("from_blk"))
            least.write.parquet(f"{at}/truncations")
            # a block with data that a truncate cuts through keeps its head only; what is a hole stays one
            edges = cuts.where(F.col("cut") % self.block_size != 0).withColumn("blk_idx", F.call_function("div", "cut", F.lit(self.block_size)))
            edges = edges.join(head.versions(keys=edges).where("kind = 'data'"), ["file_id", "blk_idx"], "left_semi").select("file_id", F.lit(-(1 << 61)).cast("long").alias("seq"), F.lit("write_zero").alias("op"), F.col("cut").alias("offset"), (F.lit(self.block_size) - F.col("cut") % self.block_size).alias("len"), F.lit(None).cast("binary").alias("data"))
            writes = fold.surviving_writes(ops).select(*[f.name for f in OPS.fields])
            parts = fold.patches(writes.unionByName(edges), self.block_size)
            held = head.blocks(keys=parts).join(least, "file_id", "left").where("from_blk IS NULL OR blk_idx < from_blk OR blk_idx = from_blk - 1")
            new = fold.fold_blocks(parts, self.block_size, held)
            new.select("file_id", "blk_idx", "kind", "data").repartition("file_id", "blk_idx").sortWithinPartitions("file_id", "blk_idx").write.parquet(f"{at}/segments")
            joined = sizes.join(old.drop("size", "cno", "deleted"), "file_id", "left")
            joined.select("file_id", "size", F.coalesce("mode", F.lit(modes.FILE_MODE).cast("long")).alias("mode"), F.coalesce("uid", F.lit(1000).cast("long")).alias("uid"), F.coalesce("gid", F.lit(1000).cast("long")).alias("gid"), F.coalesce("nlink", F.lit(1).cast("long")).alias("nlink"), F.lit(False).alias("deleted"), F.coalesce("atime", F.lit(at_)).alias("atime"), F.lit(at_).alias("mtime"), F.coalesce("ctime", F.lit(at_)).alias("ctime")).write.parquet(f"{at}/inodes")

        return self._retry(token or uuid.uuid4().hex, write)

    def _one(self, file_id: int, op: str, offset: int, length: int, data: bytes | None) -> int | None:
        return self.apply(self.spark.createDataFrame([(file_id, 0, op, offset, length, data)], OPS))

    def write(self, file_id: int, offset: int, data: bytes) -> int | None:
        return self._one(file_id, "write", offset, len(data), bytes(data)) if data else None

    def write_zero(self, file_id: int, offset: int, length: int) -> int | None:
        return self._one(file_id, "write_zero", offset, length, None) if length else None

    def truncate(self, file_id: int, size: int) -> int | None:
        return None if self.stat(file_id)["size"] == size else self._one(file_id, "truncate", size, 0, None)

    def write_batch(self, rows: DataFrame) -> int | None:
        """Whole and partial blocks (file_id, seq, blk_idx, off, len, data; null data: zeros)."""
        offset = (F.col("blk_idx") * self.block_size + F.col("off")).cast("long")
        return self.apply(rows.select("file_id", "seq", F.when(F.col("data").isNull(), "write_zero").otherwise("write").alias("op"), offset.alias("offset"), F.col("len").cast("long").alias("len"), "data"))

    def write_aligned_batch(self, rows: DataFrame) -> int | None:
        """Whole blocks (file_id, seq, blk_idx, data; null data: zeros); of a block given twice, the last stays."""
        last = batch.aligned_last_wins(rows)
        return self.write_batch(last.select("file_id", "seq", "blk_idx", F.lit(0).alias("off"), F.lit(self.block_size).alias("len"), "data"))

    def replay(self, log: DataFrame, token: str | None = None) -> int | None:
        """A write-ahead log (file_id, segid, seq, offset, len, is_zero, data), of segments not yet persisted."""
        pending = control.pending_segments(log, self.heads())
        return self.apply(pending.select("file_id", (F.col("segid") * (1 << 31) + F.col("seq")).alias("seq"), F.when(F.col("is_zero"), "write_zero").otherwise("write").alias("op"), "offset", "len", "data"), token)

    # -- the write-ahead log

    def submit(self, ops: DataFrame) -> int | None:
        """Appends writes and zero writes to the log; commits them once the policy says so, and returns that commit.

        The policy is that of RuntimeConfig: dirty blocks, dirty bytes, or the
        time since the last flush.
        """
        if self.cno is not None or self.wal is None:
            raise ReadOnly(self.root)
        rows = ops.select(*[f.name for f in OPS.fields]).where("len > 0")
        self.wal.append(rows, self.last_cno())
        touched = rows.select("file_id", "len", F.inline(block_ranges(F.col("offset"), F.col("len"), self.block_size)).alias("blk_idx", "off", "part")).agg(F.countDistinct("file_id", "blk_idx"), F.sum("part")).first()
        self._dirty, self._dirty_bytes = self._dirty + touched[0], self._dirty_bytes + (touched[1] or 0)
        over = self._dirty > self.runtime.max_dirty_blocks(self.block_size) or self._dirty_bytes > self.runtime.dirty_bytes or (self.now() - self._flushed) * 1000 >= self.runtime.flush_interval_ms
        return self.flush() if over else None

    def flush(self) -> int | None:
        """Commits what the log holds and no commit does; the log's segments below the new head go."""
        if self.wal is None or not self.wal.segments():
            return None
        pending = self.wal.pending(self.heads())
        top, rows = self.wal.segments()[-1], pending.count()
        # the log counts on over its segments, so its own order is that of the operations
        ops = pending.select("file_id", "seq", F.when(F.col("is_zero"), "write_zero").otherwise("write").alias("op"), "offset", "len", "data")
        number = self._apply(ops, f"log-{top}-{rows}") if rows else None
        self.wal.remove([n for n in self.wal.segments() if n <= top])
        self._dirty, self._dirty_bytes, self._flushed = 0, 0, self.now()
        return number

    # -- files and attributes

    def _put_inodes(self, rows: Callable[[BlockStore], DataFrame]) -> int:
        def write(base: int, at: str) -> None:
            rows(self.snapshot(base)).select(*[f.name for f in INODES.fields]).write.parquet(f"{at}/inodes")
            self.spark.createDataFrame([], SEGMENTS).write.parquet(f"{at}/segments")
            self.spark.createDataFrame([], TRUNCATIONS).write.parquet(f"{at}/truncations")

        return self._retry(uuid.uuid4().hex, write)

    def create(self, file_id: int, mode: int = modes.FILE_MODE) -> int:
        def rows(head: BlockStore) -> DataFrame:
            if not head.inodes(F.col("file_id") == file_id).isEmpty():
                raise FileExistsError(file_id)
            if self.wal and not self.wal.rows().where(F.col("file_id") == file_id).isEmpty():
                raise Busy(file_id)
            at = float(self.now())
            return self.spark.createDataFrame([(file_id, 0, modes.S_IFREG | (mode & 0o7777) if not mode & modes.S_IFMT else mode, 1000, 1000, 1, False, at, at, at)], INODES)

        return self._put_inodes(rows)

    def open_or_create(self, file_id: int) -> dict:
        try:
            return self.stat(file_id)
        except FileNotFoundError:
            self.create(file_id)
            return self.stat(file_id)

    def setattr(self, file_id: int, **fields: float) -> int:
        """Sets size, mode, uid, gid, nlink or times as they are given; blocks stay.

        That makes no commit: the record belongs to the last one, whose number is returned.
        """
        if self.cno is not None:
            raise ReadOnly(self.root)
        if not set(fields) <= {"size", "mode", "uid", "gid", "nlink", "atime", "mtime"}:
            raise ValueError(f"no such attribute: {set(fields)}")
        self.stat(file_id)
        while True:
            number = self.last_cno()
            before = [x for x in self._list("attrs") if x.startswith(f"{number:010d}-") and len(x) == 21]
            seq = int(before[-1][11:]) + 1 if before else 0
            if self._create(f"{self.root}/attrs/{number:010d}-{seq:010d}", json.dumps({"file_id": file_id, "fields": fields})):
                return number

    def flush_times(self) -> None:
        """Keeps the times of reads since the last call."""
        for file_id, at in self._read_at.items():
            self.setattr(file_id, atime=at)
        self._read_at.clear()

    def chmod(self, file_id: int, mode: int) -> int:
        old = self.stat(file_id)["mode"]
        return self.setattr(file_id, mode=old & modes.S_IFMT | mode & ~modes.S_IFMT)

    def chown(self, file_id: int, uid: int, gid: int) -> int:
        return self.setattr(file_id, uid=uid, gid=gid)

    def unlink(self, file_id: int) -> int:
        """Removes a file; a later file of the same id starts empty."""
        self.settle()
        if self.inodes(F.col("file_id") == file_id).isEmpty():
            raise FileNotFoundError(file_id)
        number = self.unlink_many(self.spark.createDataFrame([(file_id,)], "file_id long"))
        if self.on_unlink:
            try:
                self.on_unlink(file_id)
            except Exception as e:
                print(f"on_unlink hook failed: {e}")
        return number

    def unlink_many(self, files: DataFrame) -> int:
        """Removes the files (file_id) that exist, in one commit."""
        self.settle()

        def write(base: int, at: str) -> None:
            own = self.snapshot(base).inodes().join(files.select("file_id").distinct(), "file_id", "left_semi")
            own.withColumn("deleted", F.lit(True)).select(*[f.name for f in INODES.fields]).write.parquet(f"{at}/inodes")
            self.spark.createDataFrame([], SEGMENTS).write.parquet(f"{at}/segments")
            own.select("file_id", F.lit(0).cast("long").alias("from_blk")).write.parquet(f"{at}/truncations")

        return self._retry(uuid.uuid4().hex, write)

    # -- maintenance

    def recover(self, now: Callable[[], float] = time.time) -> int | None:
        """Publishes a finished attempt for the next number that its writer never committed.

        Attempts younger than ADOPT_AFTER are left to their writers.
        """
        head = self.last_cno()
        for name in self._list("data"):
            if int(name[:10]) == head + 1 and "_done" in self._list(f"data/{name}") and self._read(f"{self.root}/data/{name}/_done").endswith("\n"):
                fs, at = self._fs(f"{self.root}/data/{name}/_done")
                if now() - fs.getFileStatus(at).getModificationTime() / 1000 >= ADOPT_AFTER:
                    if self._create(self._path(head + 1), self._read(f"{self.root}/data/{name}/_done").rstrip("\n")):
                        return self._finish(head + 1)
        return None

    def vacuum(self, now: Callable[[], float] = time.time, older_than: float = 3600.0) -> list[str]:
        """Deletes attempts that lost their number long ago; returns their names."""
        kept = {r["attempt"] for r in self.records().values()}
        gone = []
        for name in self._list("data"):
            fs, at = self._fs(f"{self.root}/data/{name}")
            if name not in kept and int(name[:10]) <= self.last_cno() and now() - fs.getFileStatus(at).getModificationTime() / 1000 >= older_than:
                fs.delete(at, True)
                gone.append(name)
        return gone
