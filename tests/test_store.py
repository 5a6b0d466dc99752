"""The store against an in-memory model, and its commit protocol."""

import random

import pytest
from pyspark.sql import functions as F

from blockweave.config import MetaConfig, NodeCacheConfig, RuntimeConfig, StoreConfig
from blockweave.sources import store as S
from blockweave.sources.store import OPS, BlockStore

BS = 16


@pytest.fixture
def store(spark, tmp_path):
    return BlockStore(spark, f"file://{tmp_path}/s", block_size=BS, sleep=lambda s: None)


class Model:
    def __init__(self):
        self.files = {}

    def apply(self, f, op, offset, length, data):
        held = self.files.setdefault(f, bytearray())
        if op == "truncate":
            del held[offset:]
            held.extend(bytes(offset - len(held)))
        elif length:
            held.extend(bytes(max(0, offset + length - len(held))))
            held[offset : offset + length] = data if op == "write" else bytes(length)


def log(seed, n, files=4, space=120):
    r = random.Random(seed)
    for k in range(n):
        op = r.choices(["write", "write_zero", "truncate"], [5, 1, 2])[0]
        offset, length = r.randrange(space), r.randrange(0, 40)
        data = r.randbytes(length) if op == "write" else None
        yield r.randrange(files), k, op, offset, 0 if op == "truncate" else length, data


def whole(store):
    ask = store.inodes().select("file_id", F.lit(0).cast("long").alias("offset"), F.col("size").alias("len"))
    return {r.file_id: bytes(r.data) for r in store.read_many(ask).collect()}


def test_random_logs_in_commits(spark, store):
    model, states = Model(), {}
    entries = list(log(7, 90))
    for k in range(0, 90, 30):
        for e in entries[k : k + 30]:
            model.apply(e[0], *e[2:])
        cno = store.apply(spark.createDataFrame(entries[k : k + 30], OPS))
        states[cno] = {f: bytes(b) for f, b in model.files.items()}
    assert store.last_cno() == 3 and store.commits() == [1, 2, 3]
    for cno, state in states.items():
        assert whole(store.snapshot(cno)) == state
    with pytest.raises(S.ReadOnly):
        store.snapshot(1).write(0, 0, b"x")


def test_single_operations(spark, store):
    assert store.create(1) == 1
    with pytest.raises(FileExistsError):
        store.create(1)
    store.write(1, 5, b"hello world, this is long")
    assert store.read(1, 0, 12) == b"\0\0\0\0\0hello w" and store.read(1, 28, 100) == b"ng" and store.read(1, 30, 5) == b""
    store.truncate(1, 16)  # a block border: the block before it stays
    assert store.read(1, 0, 99) == b"\0\0\0\0\0hello world"
    store.truncate(1, 40)
    assert store.read(1, 0, 99) == b"\0\0\0\0\0hello world" + bytes(24)
    assert store.truncate(1, 40) is None and store.write(1, 0, b"") is None
    store.write_zero(1, 6, 3)
    assert store.read(1, 5, 6) == b"h\0\0\0o "
    store.chmod(1, 0o600)
    store.chown(1, 7, 8)
    got = store.stat(1)
    assert (got["mode"], got["uid"], got["gid"], got["blocks"], got["size"]) == (0o100600, 7, 8, 1, 40)
    head = store.last_cno()
    store.unlink(1)
    with pytest.raises(FileNotFoundError):
        store.read(1, 0, 1)
    assert store.snapshot(head).read(1, 9, 2) == b"o "
    store.open_or_create(1)
    store.truncate(1, 10)
    assert store.read(1, 0, 99) == bytes(10)


def test_batches_and_replay(spark, store):
    rows = [(1, 0, 0, 0, BS, b"a" * BS), (1, 1, 0, 4, 3, b"xyz"), (1, 2, 2, 2, 5, None), (1, 3, 0, 0, BS, b"b" * BS), (1, 4, 0, 1, 2, b"QR")]
    store.write_batch(spark.createDataFrame(rows, "file_id long, seq long, blk_idx long, off int, len int, data binary"))
    assert store.read(1, 0, 99) == b"bQR" + b"b" * 13 + bytes(BS + 7)
    entries = [(1, 1, 0, 3, 2, False, b"12"), (1, 2, 0, 4, 1, True, None), (1, 0, 0, 0, 1, False, b"!")]
    cno = store.replay(spark.createDataFrame(entries, "file_id long, segid long, seq long, offset long, len long, is_zero boolean, data binary"), token="t")
    assert store.read(1, 0, 6) == b"bQR1\0b"  # segment 0 lies below the last checkpoint
    assert store.replay(spark.createDataFrame(entries, "file_id long, segid long, seq long, offset long, len long, is_zero boolean, data binary"), token="t") == cno


def test_lost_race_is_rebased(spark, store):
    store.write(1, 0, b"base")
    other = BlockStore(spark, store.root, BS)
    real, tries = store._commit, []

    def slow(base, token, write):
        if not tries:
            other.write(1, 2, b"OTHER")
        tries.append(base)
        return real(base, token, write)

    store._commit = slow
    assert store.write(1, 0, b"me") == 3 and tries == [1, 2]
    assert store.read(1, 0, 9) == b"meOTHER"
    assert store.snapshot(2).read(1, 0, 9) == b"baOTHER"
    store._commit = lambda *a: None
    with pytest.raises(S.Conflict):
        store.write(1, 0, b"z")


def test_recovery(spark, store):
    store.write(1, 0, b"one")
    create = store._create
    store._create = lambda path, text: False if "/commits/" in path else create(path, text)
    with pytest.raises(S.Conflict):
        store.write(1, 0, b"two")
    store._create = create
    assert store.read(1, 0, 3) == b"one" and store.recover(lambda: 0) is None
    import time

    assert store.recover(lambda: time.time() + 10) == 2
    assert store.read(1, 0, 3) == b"two"
    assert len(store.vacuum(lambda: time.time() + 9999)) == S.RETRIES


def test_hooks_and_segments(spark, store):
    seen = []
    store.on_commit = lambda n: (seen.append(n), 1 / 0)
    store.write(1, 0, b"x" * 40)
    store.write(2, 100, b"y")
    assert seen == [1, 2]
    assert sorted(map(tuple, store.segments().collect())) == [(1, 1, 3), (2, 2, 1)]
    assert [r.blk_idx for r in store.segment(2).collect()] == [6]
    assert store.apply(spark.createDataFrame([], OPS)) is None


def test_config():
    c = StoreConfig(MetaConfig(data_block_size=10000, meta_block_size=1), RuntimeConfig.large(), NodeCacheConfig.parse("LocalDisk,/x,12,ReuseCache"))
    assert (c.meta.data_block_size, c.meta.meta_block_size) == (8192, 4096)
    assert StoreConfig.from_json(c.to_json(pretty=True)) == c
    assert RuntimeConfig().max_dirty_blocks(4096) == 2048
    for bad in ("", "LocalDisk,/x,12,Disabled", "LocalDisk,,1,Recreate", "Disk,/x,1,Recreate", "LocalDisk,/x,z,Recreate", "LocalDisk,/x,1,Other", "a,b"):
        assert NodeCacheConfig.parse(bad).mode == "Disabled"
    with pytest.raises(ValueError):
        StoreConfig.from_json("{}")


def test_whole_files(spark, tmp_path):
    from blockweave.sources.format import read_files, write_files

    root = f"file://{tmp_path}/w"
    first = spark.createDataFrame([(1, b"abc" * 20), (2, b"")], "file_id long, data binary")
    assert write_files(spark, first, root, BS) == 1 and write_files(spark, spark.createDataFrame([(1, b"z")], "file_id long, data binary"), root, BS) == 2
    assert {r.file_id: bytes(r.data) for r in read_files(spark, root, BS).collect()} == {1: b"z", 2: b""}
    assert {r.file_id: bytes(r.data) for r in read_files(spark, root, BS, cno=1).collect()} == {1: b"abc" * 20, 2: b""}


def test_cursor_and_aligned_batch(spark, store):
    from blockweave.sources.cursor import FileCursor

    rows = [(1, 0, 0, b"a" * BS), (1, 1, 1, b"c" * BS), (1, 2, 0, b"b" * BS), (1, 3, 2, None)]
    store.write_aligned_batch(spark.createDataFrame(rows, "file_id long, seq long, blk_idx long, data binary"))
    f = FileCursor(store, 1)
    assert f.read(BS + 2) == b"b" * BS + b"cc" and f.tell() == BS + 2
    assert f.seek(-4, 2) == 3 * BS - 4 and f.read(100) == bytes(4) and f.read(5) == b""
    f.seek(2)
    assert f.write(b"XY") == 2 and f.truncate() == 4
    f.seek(0)
    assert f.read() == b"bbXY"
    with pytest.raises(S.ReadOnly):
        FileCursor(store.snapshot(1), 1).write(b"x")
    with pytest.raises(FileNotFoundError):
        FileCursor(store, 9)


def test_a_writer_that_died_wedges_nothing(spark, store):
    """A record without its end is put aside once it is old; a slow writer loses to whoever did that."""
    import time

    store.write(1, 0, b"one")
    fs, at = store._fs(f"{store.root}/commits/{2:010d}")
    out = fs.create(at, False)
    out.write(bytearray(b'{"attempt": "half'))
    assert store.commits() == [1] and store.read(1, 0, 9) == b"one"
    store.now = lambda: 0.0
    with pytest.raises(S.Conflict):
        store.write(1, 0, b"two")
    store.now = lambda: time.time() + 60
    assert store.write(1, 0, b"two") == 2 and BlockStore(spark, store.root, BS).read(1, 0, 9) == b"two"
    out.close()
    assert store.recover(lambda: 0) is None and store.write(1, 3, b"!") == 3 and store.read(1, 0, 9) == b"two!"


def test_log(spark, tmp_path):
    """Logged operations are committed by the policy, before a read, and when the store is opened again."""
    root, clock = f"file://{tmp_path}/l", [100.0]
    settings = RuntimeConfig(dirty_bytes=BS * 4, dirty_blocks=4)
    new = lambda: BlockStore(spark, root, BS, sleep=lambda s: None, log=True, runtime=settings, now=lambda: clock[0])
    ops = lambda *rows: spark.createDataFrame([(f, k, "write" if d else "write_zero", o, len(d or b"") or n, d) for k, (f, o, d, n) in enumerate(rows)], OPS)
    store = new()
    assert store.submit(ops((1, 0, b"abcdef", 0), (1, 2, None, 2))) is None and store.commits() == []
    assert store.submit(ops((1, 5, b"Z", 0))) is None and store.wal.segments() == [0]
    assert [(r.key, r.is_zero) for r in store.wal.chunks(0).collect()] == [("wal/0000000000/0_0_6", False), ("wal/0000000000/1_2_2", True), ("wal/0000000000/2_5_1", False)]
    assert store.wal.read_chunk(1, 0, 0) == b"abcdef" and store.wal.read_chunk(1, 0, 1) == b"\0\0" and store.wal.read_chunk(2, 0, 0) is None
    assert "PartitionFilters: [isnotnull(segid" in store.wal.chunks(0)._jdf.queryExecution().toString()
    unopened = BlockStore(spark, root, BS)
    unopened.wal = store.wal
    with pytest.raises(S.Busy):
        unopened.create(1)
    again = new()  # as after a crash
    assert again.commits() == [1] and again.wal.segments() == [] and again.read(1, 0, 9) == b"ab\0\0eZ"
    again.submit(ops((1, 0, b"Q", 0)))
    assert again.read(1, 0, 2) == b"Qb" and again.commits() == [1, 2]  # reads see what was logged
    assert again.submit(ops(*[(2, BS * k, b"x" * BS, 0) for k in range(6)])) == 3  # too many dirty blocks
    clock[0] += 6
    assert again.submit(ops((2, 1, b"y", 0))) == 4  # too long ago
    again.submit(ops((2, 0, b"t", 0)))
    again.unlink(2)
    assert again.commits() == [1, 2, 3, 4, 5, 6] and new().commits()[-1] == 6
    again.wal.write(9, 5, 0, b"old")  # a commit after segment 5 holds nothing of file 9 yet
    again.wal.write(2, 5, 0, b"gone")  # that of file 2 does
    last = new()
    assert last.read(9, 0, 5) == b"old"
    with pytest.raises(FileNotFoundError):
        last.read(2, 0, 1)
    with pytest.raises(ValueError):
        last.submit(spark.createDataFrame([(1, 0, "truncate", 0, 1, None)], OPS))


def test_attributes_make_no_commit(spark, store):
    clock = [1000.0]
    store.now = lambda: clock[0]
    store.create(1)
    clock[0] = 2000.0
    assert store.chmod(1, 0o640) == 1 and store.chown(1, 3, 4) == 1 and store.commits() == [1]
    got = store.stat(1)
    assert (got["mode"], got["uid"], got["gid"], got["ctime"], got["mtime"]) == (0o100640, 3, 4, 1000.0, 1000.0)
    store.write(1, 0, b"abc")
    got = store.stat(1)
    assert (got["mode"], got["uid"], got["mtime"], got["ctime"]) == (0o100640, 3, 2000.0, 1000.0)
    clock[0] = 3000.0
    store.read(1, 0, 1)
    assert store.stat(1)["atime"] == 3000.0 and BlockStore(spark, store.root, BS).stat(1)["atime"] == 1000.0
    store.flush_times()
    assert BlockStore(spark, store.root, BS).stat(1)["atime"] == 3000.0 and store.commits() == [1, 2]
    assert store.snapshot(1).stat(1)["size"] == 0 and store.snapshot(1).stat(1)["uid"] == 3


def test_reads_are_pruned(spark, store):
    store.write(1, 0, bytes(range(1, 100)))
    store.write(2, 0, b"x" * 40)
    own = (F.col("file_id") == 1) & F.col("blk_idx").between(1, 2)
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    plan = store.blocks(own)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(file_id,1)" in plan and "LessThanOrEqual(blk_idx,2)" in plan
    versions = store.versions(own)._jdf.queryExecution().executedPlan().toString()
    assert "data:binary" not in versions
    reads = []
    real = store._read
    store._read = lambda path: (reads.append(path), real(path))[1]
    for _ in range(3):
        store.read(1, 20, 5)
    assert reads == []  # known records are not read again
    assert store.exists("commits/0000000001") and not store.exists("commits/0000000009")
    assert store.objects("data").where("path LIKE '%segments%parquet' AND bytes > 0").count() >= 2


def test_a_cut_makes_no_blocks(spark, store):
    """A truncate inside a block that holds nothing leaves a hole, as folding the log in one batch does."""
    kept = lambda: sorted((r.file_id, r.blk_idx, r.kind) for r in store.blocks().collect())
    first = [(1, 0, "write", 20, 4, b"abcd"), (1, 1, "truncate", 5, 0, None), (2, 0, "truncate", 21, 0, None), (3, 0, "write", 0, 4, b"abcd"), (3, 1, "truncate", 2, 0, None), (4, 0, "truncate", 9, 0, None), (4, 1, "write", 3, 2, b"xy")]
    store.apply(spark.createDataFrame(first, OPS))
    assert kept() == [(3, 0, "data"), (4, 0, "data")]
    second = [(2, 2, "truncate", 3, 0, None), (3, 2, "truncate", 1, 0, None), (4, 2, "truncate", 35, 0, None), (5, 0, "truncate", 7, 0, None)]
    store.apply(spark.createDataFrame(second, OPS))
    assert kept() == [(3, 0, "data"), (4, 0, "data")]
    assert whole(store) == {1: bytes(5), 2: bytes(3), 3: b"a", 4: bytes(3) + b"xy" + bytes(30), 5: bytes(7)}
