"""Every query with an equivalent in SQL gives the same rows."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as driver
from blockweave.plans import catalog


@pytest.fixture(scope="module")
def tables(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def text(rows):
    return sorted(tuple(map(str, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_as_sql(spark, sf, tables, name):
    df = catalog.QUERIES[name](spark, sf)
    names = sorted(df.columns)
    found = tables.execute(catalog.ORACLE[name])
    order = [d[0] for d in found.description]
    assert sorted(order) == names
    assert text([r[c] for c in names] for r in df.collect()) == text([r[order.index(c)] for c in names] for r in found.fetchall())


def test_stream_equals_batch(spark, sf):
    rows = catalog.QUERIES["q34_streaming_equals_batch"](spark, sf).collect()
    assert rows and all(r.equal for r in rows)


def test_only_a_missing_subpackage_is_passed_over(tmp_path):
    """Without the text operators the rest works; a broken import inside them shows."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(driver.__file__))
    shutil.copytree(os.path.join(root, "blockweave"), tmp_path / "blockweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, capture_output=True, text=True)
    assert int(run().stdout) == len(catalog.QUERIES)
    (tmp_path / "blockweave/llm").mkdir()
    (tmp_path / "blockweave/llm/__init__.py").write_text("")
    (tmp_path / "blockweave/llm/queries.py").write_text("import no_such_module")
    (tmp_path / "corpus_pipeline.py").write_text("")
    assert "no_such_module" in run().stderr


def test_conflicts_are_counted_without_pairs(spark):
    import random

    from pyspark.sql import functions as F

    from blockweave.operators import control

    r = random.Random(6)
    rows = [(k, r.randrange(4), s, s + r.randrange(0, 60)) for k, s in enumerate(r.randrange(200) for _ in range(150))] + [(900 + k, 7, 0, 10) for k in range(30)]
    df = spark.createDataFrame(rows, "id long, file_id long, start long, end long")
    for align in (1, 16):
        listed = control.lock_conflicts(df, align).groupBy("file_id").agg(F.count("*").alias("n")).collect()
        assert {x.file_id: x.n for x in listed} == {x.file_id: x.n_conflicts for x in control.conflict_counts(df, align).collect()}


def test_dumps(spark):
    from pyspark.sql import functions as F

    from blockweave.functions import dumps

    at, n = F.timestamp_seconds(F.lit(0)), F.lit
    rows = spark.range(1).select(
        dumps.inode_text(n(5), n(True), n(None), n(None), n(513), n(1), n(2), n(0o100644), n(0), n(1), at, at, at, (n(56), n(4096), n(8192), n("Flat")), n(9), n(3), n(2)).alias("inode"),
        dumps.segment_text(n(5), n(3), n(4), n(0xABC), n(255), n(4096), n(1), n(12), n(13), n(1), n(2)).alias("segment"),
    ).first()
    assert rows.inode.split("\n") == ["==== dump Inode ino: 5 attr dirty: true ====", "  ondisk checksum: -, ondisk timestamp: -", "  file size: 513, blocks: 2", "  uid: 1, gid: 2, mode: 0o100644, flags: 0, nlink: 1", "  access time: 1970-01-01T00:00:00Z", "  change time: 1970-01-01T00:00:00Z", "  modify time: 1970-01-01T00:00:00Z", "  format: Flat, root size: 56, meta block size: 4096, data block size: 8192", "  last seq: 9, last cno: 3, last ondisk cno: 2"]
    assert rows.segment.split("\n") == ["==== dump Segment Summary ====", "  ino: 5, cno: 3, next segment: 4", "  magic 0xabc, checksum: 0xff", "  bytes: 4096, flags: 0x1", "  meta block shift: 12, data block shift: 13", "  meta block count: 1, data block count: 2"]


def test_driver(spark):
    assert driver.entry(spark).count() == 200
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert set(catalog.QUERIES) <= set(driver.queries())
