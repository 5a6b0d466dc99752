"""Addressing, names, modes, folds and checkpoints."""

import random

import pytest
from pyspark.sql import functions as F

from blockweave.functions import addressing as A, modes, names
from blockweave.operators import batch, blocks, control, fold, snapshots

OPS = "file_id long, seq long, op string, offset long, len long, data binary"
BS = 16


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def lit(x):
    return F.lit(x).cast("long")


def test_block_ranges(spark):
    cases = [(0, 0), (0, 1), (5, 3), (0, 16), (15, 2), (7, 50), (16, 16), (31, 1), (100, 0)]
    df = spark.createDataFrame(cases, "o long, n long").select("o", "n", A.block_ranges(F.col("o"), F.col("n"), BS).alias("r"))
    for o, n, r in df.collect():
        want = {}
        for p in range(o, o + n):
            want.setdefault(p // BS, []).append(p % BS)
        assert [(x.blk_idx, x.off, x.len) for x in r] == [(b, v[0], len(v)) for b, v in sorted(want.items())]


def test_pointers(spark):
    top = (A.SEGMENT_LIMIT - 1, A.UNIT_LIMIT - 1, (1 << 18) - 1)
    for segid, unit, seq in [(0, 0, 0), (1, 2, 35), top]:
        p = A.encode_micro_group(lit(segid), lit(unit * 4096), lit(seq))
        r = one(spark, p=p, s=A.decode_segid(p), o=A.decode_unit_offset(p), g=A.decode_group(p), k=A.pointer_kind(p), d=A.display(p))
        assert (r.s, r.o, r.g, r.k) == (segid, unit * 4096, seq >> 4, "staging") and r.p >> 62 == 1
        assert r.d == f"[Staging: id {segid} - offset {unit * 4096} - group {seq >> 4}]"
        f = A.encode_flat(lit(segid), lit(unit))
        r = one(spark, s=A.decode_segid(f), o=A.decode_flat_offset(f))
        assert (r.s, r.o) == (segid, unit)
    bad = one(spark, a=A.encode_micro_group(lit(A.SEGMENT_LIMIT), lit(0), lit(0)), b=A.encode_micro_group(lit(0), lit(1 << 30), lit(0)), c=A.encode_flat(lit(0), lit(1 << 32)), d=A.encode_micro_group(lit(0), lit(0), lit(1 << 18)))
    assert list(bad) == [None] * 4
    kinds = one(spark, a=A.display(lit(A.ZERO_BLOCK)), b=A.display(lit(A.DUMMY)), c=A.display(lit(0)), d=A.display(lit(255)))
    assert list(kinds) == ["[Zero Block]", "[Dummy]", "[Invalid]", "[Unkown: 0xff]"]


def test_meta_words(spark):
    w = A.pack_meta_config(lit(1), lit(10000), lit(2))
    r = one(spark, w=w, **A.unpack_meta_config(w), n=A.unpack_map_data(A.pack_map_data(lit(2))), s=A.summary_bytes(lit(243)), t=A.summary_bytes(lit(244)))
    assert (r.w, r.root_size, r.meta_block_size, r.data_block_size, r.format) == (7 << 24 | 12 << 16 | 13 << 8 | 2, 56, 4096, 8192, 2)
    assert (r.n, r.s, r.t) == ("micro_group", 4096, 8192)
    z = one(spark, a=A.is_all_zeros(F.lit(bytes(9))), b=A.is_all_zeros(F.lit(b"\0\1")), c=A.is_all_zeros(F.lit(b"")))
    assert list(z) == [True, False, True]


def test_names(spark):
    rows = spark.createDataFrame([(x,) for x in ("0_5_7", "1_2", "a_1_2", "1_2_3_4", "1__3", "+1_2_3")], "n string")
    got = [None if r.p is None else tuple(r.p) for r in rows.select(names.parse_log_name(F.col("n")).alias("p")).collect()]
    assert got == [(0, 5, 7), None, None, None, None, (1, 2, 3)]
    r = one(spark, k=names.log_key("w", lit(12), lit(0), lit(5), lit(7)), s=names.segment_name(lit(12345678901)))
    assert (r.k, r.s) == ("w/0000000012/0_5_7", "12345678901")
    uris = {"s3://b/k": ("b", "k", None), "S3://b/k/x": ("b", "k/x", None), "s3:/b/k": (None, None, names.NO_SCHEME), "s3://b": (None, None, names.INCOMPLETE), "s3://b/": (None, None, names.NO_KEY), "s3:///k": ("", "k", None)}
    df = spark.createDataFrame([(u,) for u in uris], "u string")
    assert {r.u: (r.bucket, r.key, r.error) for r in df.select("u", *[c.alias(n) for n, c in names.parse_location(F.col("u")).items()]).collect()} == uris
    d = spark.createDataFrame([("a/b/c",), ("c",), ("/c",)], "p string").select(*[c.alias(n) for n, c in names.split_directory(F.col("p")).items()])
    assert [tuple(r) for r in d.collect()] == [("a/b", "c"), ("", "c"), ("", "c")]
    assert names.staging_root("s3://r/", "k") == names.staging_root("s3://r", "k") == ("s3://r/k", "s3://r/k/inode")
    assert names.staging_path("b", "/k", "root/") == ("s3://b/root/k", "s3://b/root/k/inode")
    assert names.derive(("s3://b/k", "s3://b/k/inode"), "k", "z") == ("s3://b/z", "s3://b/z/inode")
    with pytest.raises(ValueError):
        names.staging_root("file:///x", "k")


def test_modes(spark):
    m = lit(0o100644)
    f = lit(0o2 | 0o2000 | 0o4010000)
    r = one(spark, a=modes.chmod(m, lit(0o040755)), b=modes.with_mode(m, lit(0o600)), c=modes.with_mode(m, lit(0o040700)), d=modes.show_mode(lit(0o040755)), e=modes.show_flags(f), g=modes.flushes_each_write(f), h=modes.flushes_each_write(lit(0)), i=modes.is_directory(lit(0o040755)))
    assert list(r) == [0o100755, 0o100600, 0o040700, "S_IFDIR | 0o755", "O_RDWR | O_APPEND | O_DSYNC | O_SYNC", True, False, True]


def model(entries):
    files = {}
    for f, _, op, o, n, data in entries:
        held = files.setdefault(f, bytearray())
        if op == "truncate":
            del held[o:]
            held.extend(bytes(o - len(held)))
        elif op != "flush" and n:
            held.extend(bytes(max(0, o + n - len(held))))
            held[o : o + n] = data if op == "write" else bytes(n)
    return {f: bytes(b) for f, b in files.items()}


def random_log(seed, n=120, flush=0):
    r = random.Random(seed)
    out = []
    for k in range(n):
        op = r.choices(["write", "write_zero", "truncate", "flush"], [5, 1, 2, flush])[0]
        o, size = r.randrange(120), r.randrange(0, 50)
        data = r.randbytes(size) if op == "write" else None
        out.append((r.randrange(3), k, op, 0 if op == "flush" else o, 0 if op in ("truncate", "flush") else size, data))
    return out


def contents(ops, block_map, bs=BS, **options):
    sizes = fold.final_sizes(ops, **options)
    ask = sizes.select("file_id", F.lit(0).cast("long").alias("offset"), F.col("size").alias("len"))
    return {r.file_id: bytes(r.data) for r in blocks.read_ranges(ask, sizes, block_map.where("kind = 'data'"), bs).collect()}


@pytest.mark.parametrize("stretch", [None, 7])
def test_fold(spark, stretch):
    entries = random_log(3)
    ops = spark.createDataFrame(entries, OPS)
    assert contents(ops, fold.content(ops, BS, stretch), stretch=stretch) == model(entries)


DIRECTED = [
    [("write", 0, 48, 1), ("truncate", 32, 0, 0)],
    [("write", 0, 48, 1), ("truncate", 20, 0, 0), ("truncate", 48, 0, 0)],
    [("write", 0, 16, 1), ("write_zero", 0, 16, 0)],
    [("write", 30, 3, 1), ("write_zero", 31, 1, 0), ("truncate", 0, 0, 0)],
    [("write", 5, 0, 1), ("write", 40, 0, 1)],
    [("truncate", 33, 0, 0), ("write", 34, 1, 1), ("truncate", 33, 0, 0)],
    [("write", 0, 16, 1), ("write", 4, 4, 2), ("write", 0, 16, 3), ("write", 15, 2, 4)],
]


def test_directed(spark):
    entries = [(f, k, op, o, n, bytes([v]) * n if op == "write" else None) for f, ops in enumerate(DIRECTED) for k, (op, o, n, v) in enumerate(ops)]
    ops = spark.createDataFrame(entries, OPS)
    assert contents(ops, fold.content(ops, BS)) == model(entries)
    zero = fold.content(ops, BS).where("file_id = 2").collect()
    assert [(r.kind, r.data) for r in zero] == [("zero", None)]


def test_short_reads(spark):
    data = spark.createDataFrame([(1, b"0123456789" * 4)], "file_id long, data binary")
    held = blocks.split_blocks(data, BS)
    sizes = data.select("file_id", F.lit(40).cast("long").alias("size"))
    asks = [(0, 5), (38, 10), (40, 1), (99, 3), (10, 0), (15, 18)]
    got = blocks.read_ranges(spark.createDataFrame([(1, o, n) for o, n in asks], "file_id long, offset long, len long"), sizes, held, BS).collect()
    assert {(r.offset, r.bytes_read): bytes(r.data) for r in got} == {(o, len((b"0123456789" * 4)[o : o + n])): (b"0123456789" * 4)[o : o + n] for o, n in asks}


def test_checkpoints(spark):
    entries = random_log(9, 150, flush=2)
    ops = snapshots.assign_checkpoints(spark.createDataFrame(entries, OPS), truncate_flushes=True).cache()
    numbers = {(r.file_id, r.seq): r.cno for r in ops.collect()}
    want, at, fresh = {}, {}, {}
    for f, k, op, *_ in entries:
        if op != "flush":
            if fresh.get(f, True):
                at[f], fresh[f] = at.get(f, 0) + 1, False
            want[f, k] = at[f]
        if op in ("flush", "truncate"):
            fresh[f] = True
    assert numbers == want
    for n in (1, 3, 6):
        seen = [e for e in entries if e[2] != "flush" and want[e[0], e[1]] <= n]
        assert contents(snapshots.as_of(ops, n), snapshots.snapshot(ops, BS, n)) == model(seen)
    same = snapshots.difference(snapshots.snapshot(ops, BS, 4), snapshots.snapshot(ops, BS, 4))
    assert same.count() == 0


def test_batches(spark):
    rows = [(1, 0, 0, 0, BS, b"a" * BS), (1, 1, 0, 0, BS, b"b" * BS), (1, 2, 0, 3, 2, b"xy"), (1, 3, 1, 4, 4, b"1234"), (1, 4, 1, 5, 2, None), (1, 5, 2, 0, BS, None)]
    df = spark.createDataFrame(rows, "file_id long, seq long, blk_idx long, off int, len int, data binary")
    base = spark.createDataFrame([(1, 1, b"z" * BS), (1, 0, b"never")], "file_id long, blk_idx long, data binary")
    got = {r.blk_idx: (r.kind, r.data and bytes(r.data)) for r in batch.merge_batch(df, BS, base).collect()}
    assert got == {0: ("data", b"bbbxy" + b"b" * 11), 1: ("data", b"zzzz1\0\0004" + b"z" * 8), 2: ("zero", None)}
    assert {r.blk_idx: r.needs_fetch for r in batch.needs_base(df, BS).collect()} == {0: False, 1: True, 2: False}
    assert batch.batch_sizes(df.where("seq = 3"), BS).first().size == BS + 8
    assert [(r.blk_idx, r.seq) for r in batch.aligned_last_wins(df.where("blk_idx = 0 AND off = 0")).collect()] == [(0, 1)]


def test_locks_and_policy(spark):
    r = random.Random(2)
    ranges = [(i, i % 2, s, s + r.randrange(0, 60)) for i in range(60) for s in [r.randrange(200)]]
    got = {(x.a, x.b) for x in control.lock_conflicts(spark.createDataFrame(ranges, "id long, file_id long, start long, end long"), BS).collect()}
    al = [(i, f, s // BS * BS, -(-e // BS) * BS) for i, f, s, e in ranges]
    assert got == {(a[0], b[0]) for a in al for b in al if a[0] < b[0] and a[1] == b[1] and a[2] < b[3] and b[2] < a[3] and a[3] > a[2] and b[3] > b[2]}
    plan = spark.createDataFrame([(1,), (16,), (17,), (32,)], "n long").select(*[c.alias(k) for k, c in control.upload_plan(F.col("n"), 16).items()])
    assert [tuple(x) for x in plan.collect()] == [(1, 1), (1, 16), (2, 1), (3, 0)]
    lost = control.rebase(spark.createDataFrame([(1, 1, 5, 20), (1, 2, 5, 10), (2, 1, 0, 1)], "file_id long, writer long, base_cno long, at long"))
    assert {(x.file_id, x.writer): (x.cno, x.rebased) for x in lost.collect()} == {(1, 2): (6, False), (1, 1): (7, True), (2, 1): (1, False)}
