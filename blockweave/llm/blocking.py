"""Links inside buckets, without listing the pairs of a bucket.

Used by the joins on similarity: rows sit in buckets, rows that share a bucket
may be alike, and a test on the whole texts confirms it.

First every row is compared with one row only: the hub of one of its buckets,
the member that meets most others. Groups of copies nearly always fall into one
component by that. Buckets that still mix components are cut up by keys that
every link must share (rare shingles in order, a line's letters of some groups), and
only pairs of different components that meet in such a key, and that its
bounds allow, are listed and compared.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import BROADCAST_BYTES, discard, map_batches, materialize, released, small
from .graph import components

#: Bytes that a row of ids takes in a broadcast table.
ID_BYTES = 40


class Links:
    """Confirms candidate pairs on whole texts, fetching only texts of candidates.

    fetch turns a table of ids (bw_id) into (bw_id, bw_text), where a row may
    repeat. make() runs on the executors and returns (prepare, alike): prepare
    turns a text into what alike compares.
    """

    def __init__(self, spark, fetch: Callable[[DataFrame], DataFrame], make: Callable, at: str):
        self.spark, self.fetch, self.make, self.at = spark, fetch, make, at

    def payload(self, ids: DataFrame, name: str) -> DataFrame:
        """bw_id and compressed text z of the given ids, a row each."""
        ids = materialize(self.spark, ids, self.at, f"{name}-ids")
        schema = StructType([StructField("bw_id", LongType()), StructField("z", BinaryType())])

        def make():
            import zstandard

            press = zstandard.ZstdCompressor(level=3)
            return lambda batch: [batch.column(0), [press.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()]]

        packed = materialize(self.spark, map_batches(self.fetch(ids).select("bw_id", "bw_text"), schema, make), self.at, f"{name}-texts")
        return packed if packed.count() == ids.count() else packed.dropDuplicates(["bw_id"])

    def confirm(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (x, y) that are alike."""
        if pairs.isEmpty():
            return pairs
        texts = self.payload(pairs.select(F.col("x").alias("bw_id")).unionAll(pairs.select(F.col("y").alias("bw_id"))).distinct(), name)
        joined = pairs.join(texts.select(F.col("bw_id").alias("x"), F.col("z").alias("zx")), "x").join(texts.select(F.col("bw_id").alias("y"), F.col("z").alias("zy")), "y")
        make_alike = self.make

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import zstandard

            prepare, alike = make_alike()
            unpress = zstandard.ZstdDecompressor()
            read = lambda z: prepare(unpress.decompress(z).decode("utf-8", "surrogatepass"))
            last, held = None, None
            for batch in batches:
                xs, ys, zx, zy = (batch.column(i) for i in range(4))
                xs, ys, found = xs.to_pylist(), ys.to_pylist(), []
                for i in range(batch.num_rows):
                    if ys[i] != last:
                        last, held = ys[i], read(zy[i].as_py())
                    if alike(held, read(zx[i].as_py())):
                        found.append((xs[i], ys[i]))
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], names=["x", "y"])

        found = materialize(self.spark, joined.select("x", "y", "zx", "zy").mapInArrow(released(run), "x long, y long"), self.at, f"{name}-links")
        discard(self.spark, self.at, [f"{name}-texts", f"{name}-ids"])
        return found


#: Each bucket of a row has a code of CODE_BITS bits in a lane of 16; four lanes make a long.
CODE_BITS = 14


def pack_codes(numbers: list[Column]) -> Column:
    """An array of longs with the low bits of the numbers, one lane each."""
    lane = lambda k, x: F.shiftleft(x.bitwiseAND((1 << CODE_BITS) - 1), 16 * k)
    return F.array(*[functools.reduce(Column.bitwiseOR, [lane(k, x) for k, x in enumerate(numbers[i : i + 4])]) for i in range(0, len(numbers), 4)])


def equal_codes(a: Column, b: Column, n: int) -> Column:
    """How many of n lanes two arrays of codes have in common."""
    different = F.lit(0)
    for i in range(-(-n // 4)):
        # the sum carries into the bit above a lane's code exactly where the codes differ
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))) + 0x3FFF3FFF3FFF3FFF
        different = different + F.bit_count(x.bitwiseAND(0x4000400040004000))
    return n - different


def bucket_sizes(rows: DataFrame) -> DataFrame:
    """bucket, c: how many rows the buckets have that hold more than one id."""
    several = rows.groupBy("bucket").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count(F.lit(1)).alias("c"))
    return several.where("a <> b").select("bucket", "c")


def shared_buckets(rows: DataFrame, at: str, limit: int = BROADCAST_BYTES, counted: DataFrame | None = None) -> DataFrame:
    """The rows (bucket, id, ...) whose bucket holds another id, with c, the rows of the bucket.

    rows is gone through twice rather than written: most buckets hold one id.
    counted, if given, is the same rows for the first time, with no other columns.
    """
    spark = rows.sparkSession
    several = materialize(spark, bucket_sizes(rows if counted is None else counted), at, "several")
    return materialize(spark, rows.join(small(several, ID_BYTES, limit), "bucket"), at, "buckets")


def hub_pairs(rows: DataFrame, fits: Column) -> DataFrame:
    """x, y: each id of rows (bucket, id, n, comp, w) with the heaviest hub that it may be linked with.

    A bucket's hub is its member of the greatest weight w. There are no more
    pairs than ids.
    """
    hubs = rows.groupBy("bucket").agg(F.max(F.struct("w", "id", "n", "comp")).alias("l"))
    hubs = hubs.select("bucket", F.col("l.id").alias("y"), F.col("l.n").alias("m"), F.col("l.comp").alias("comp_y"), F.col("l.w").alias("w_y"))
    met = rows.join(hubs, "bucket").where("comp <> comp_y").where(fits)
    return met.groupBy(F.col("id").alias("x")).agg(F.max(F.struct("w_y", "y")).alias("l")).select("x", F.col("l.y").alias("y"))


def link_in_buckets(
    buckets: DataFrame,
    fits: Column,
    links: Links,
    at: str,
    least_shared: int,
    refine: Callable[[DataFrame], DataFrame],
    fits_fine: Column,
    within_reach: Column | None = None,
    rounds: int = 2,
    few: int = 4,
) -> DataFrame:
    """node, component: the components of all confirmed links inside buckets (bucket, id, n, c).

    fits tells from n and m, what is known of the two rows' texts, whether they
    can be alike at all; a link shares least_shared buckets at least. refine
    turns the rows (bucket, id, n, comp) of buckets that mix components into
    rows (bucket, id, n, size, comp) of finer buckets of which every link shares
    one. There fits_fine is asked of n and m, and within_reach of n and least,
    the least size in the bucket, to leave rows out that can meet nobody.

    Of a finer bucket only pairs with a row outside its most frequent component
    are listed. While these would be more than a few times the rows, up to so
    many rounds, rows are compared with hubs again.
    """
    spark = buckets.sparkSession

    def joined(edges: DataFrame, name: str) -> DataFrame:
        return components(edges.select(F.col("x").alias("a"), F.col("y").alias("b")), at, f"components-{name}")

    def placed(rows: DataFrame, comps: DataFrame) -> DataFrame:
        own = rows.drop("comp").join(comps.select(F.col("node").alias("id"), F.col("component").alias("comp")), "id", "left")
        return own.withColumn("comp", F.coalesce("comp", "id"))

    by_id = W.partitionBy("id")
    now = buckets.withColumn("w", F.sum("c").over(by_id)).withColumn("k", F.count(F.lit(1)).over(by_id)).where(f"k >= {least_shared}")
    now = materialize(spark, now.select("bucket", "id", "n", F.col("id").alias("comp"), "w"), at, "weighted")
    edges = links.confirm(materialize(spark, hub_pairs(now, fits), at, "hubs"), "hubs")
    comps = joined(edges, "hubs")
    now = materialize(spark, placed(now, comps), at, "placed")
    mixed = now.groupBy("bucket").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("bucket")
    rest = materialize(spark, now.join(mixed, "bucket", "left_semi").select("bucket", "id", "n", "comp"), at, "mixed")
    discard(spark, at, ["weighted", "placed", "buckets"])
    if rest.isEmpty():
        return comps
    fine = materialize(spark, refine(rest), at, "fine")
    for k in range(rounds + 1):
        per = fine.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("c"), F.min("size").alias("s")).groupBy("bucket")
        per = per.agg(F.max(F.struct("c", "comp")).alias("most"), F.sum("c").alias("total"), F.count(F.lit(1)).alias("comps"), F.min("s").alias("least")).where("comps > 1")
        per = per.select("bucket", F.col("most.comp").alias("main"), "total", (F.col("total") - F.col("most.c")).alias("others"), "least")
        fine = fine.join(materialize(spark, per, at, f"keys-{k}"), "bucket")
        fine = materialize(spark, fine.where(F.lit(True) if within_reach is None else within_reach), at, f"fine-{k}")
        rows, listed = fine.agg(F.count(F.lit(1)), F.sum(F.when(F.col("comp") != F.col("main"), F.col("total")).otherwise(0))).first()
        if not rows:
            return comps
        if k == rounds or listed <= few * rows:
            break
        heavy = fine.select("bucket", "id", "n", "comp", F.sum("total").over(by_id).alias("w"))
        found = links.confirm(materialize(spark, hub_pairs(heavy, fits_fine), at, f"hubs-{k}"), f"hubs-{k}")
        edges = edges.unionAll(found)
        comps = joined(edges, str(k))
        fine = materialize(spark, placed(fine.select("bucket", "id", "n", "size"), comps), at, f"placed-{k}")
    a = fine.where("comp <> main").select("bucket", F.col("id").alias("x"), "n", "comp")
    b = fine.select("bucket", F.col("id").alias("y"), F.col("n").alias("m"), F.col("comp").alias("comp_y"))
    pairs = a.join(b, "bucket").where("comp <> comp_y").where(fits_fine).select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
    found = links.confirm(materialize(spark, pairs, at, "rest"), "rest")
    return joined(edges.unionAll(found), "rest")
