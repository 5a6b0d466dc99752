"""Near-duplicate documents by circulant MinHash, banding and exact checks.

Two permutations of the 64-bit numbers make all signature coordinates: the
first scatters the shingles, the second is shifted circularly by k for the k-th
coordinate. Bands of the signature name buckets. Documents with equal shingle
sets are one class from the start, and only one document of each class goes on.

Buckets are gone through as blocking.py says, without listing their pairs. Where
they mix components, their documents meet again in a rare shingle of the
prefix that every link must share, with bounds on sizes and places. Every link
is confirmed on the full shingle sets.

A pair is looked at if it shares two of 40 bands of 5: of pairs at the
threshold of 0.8 fewer than 3 in a million share less.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .blocking import ID_BYTES, Links, equal_codes, link_in_buckets, pack_codes, shared_buckets
from .common import discard, map_batches, materialize, released, small, stage_dir

BANDS, ROWS = 40, 5
#: Multipliers of the splitmix64 finalizer, and the golden-ratio increment.
M1, M2, GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: Lower-cases A-Z only.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def permute(z: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers, in place."""
    for shift, factor in ((30, M1), (27, M2)):
        np.right_shift(z, np.uint64(shift), out=spare)
        np.bitwise_xor(z, spare, out=z)
        np.multiply(z, factor, out=z)
    np.right_shift(z, np.uint64(31), out=spare)
    return np.bitwise_xor(z, spare, out=z)


class Shingler:
    """Texts to sorted sets of 64-bit shingle numbers, with a bounded memo of words."""

    def __init__(self, size: int, memo_limit: int = 1_000_000):
        from xxhash import xxh64_intdigest

        self.size, self.hash, self.memo, self.memo_limit = size, xxh64_intdigest, {}, memo_limit

    def numbers(self, words: list[bytes]) -> np.ndarray:
        memo = self.memo
        found = list(map(memo.get, words, repeat(None)))
        if None in found:
            if len(memo) > self.memo_limit:
                memo.clear()
            for i, n in enumerate(found):
                if n is None:
                    found[i] = memo[words[i]] = self.hash(words[i])
        return np.array(found, dtype=np.uint64)

    def shingles(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        size = min(self.size, len(words))
        numbers = self.numbers(words)
        n = len(words) - size + 1
        out = np.full(n, size, dtype=np.uint64)
        for j in range(size):
            out *= GOLDEN
            out += numbers[j : j + n]
        return np.unique(permute(out, np.empty_like(out)))


def signatures(sets: list[np.ndarray], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Band numbers (documents x bands) of non-empty sets."""
    flat = np.concatenate(sets) + GOLDEN
    first = permute(flat, np.empty_like(flat))
    starts = np.cumsum([0, *map(len, sets)][:-1])
    z, spare = np.empty_like(first), np.empty_like(first)
    out = np.empty((len(sets), bands), dtype=np.uint64)
    for band in range(bands):
        key = np.full(len(sets), band + 1, dtype=np.uint64)
        for k in range(band * rows, band * rows + rows):
            np.add(first, np.uint64(k), out=z)
            key *= GOLDEN
            key += np.minimum.reduceat(permute(z, spare), starts)
        out[:, band] = permute(key, np.empty_like(key))
    return out


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int, chunk: int = 60_000) -> DataFrame:
    """bw_id, bw_print (hash of the text), bw_n (set size), bw_set (128-bit print of the set, null if empty), bw_bands."""
    from xxhash import xxh3_128_hexdigest

    schema = StructType([StructField("bw_id", LongType()), StructField("bw_print", LongType()), StructField("bw_n", LongType()), StructField("bw_set", StringType()), StructField("bw_bands", ArrayType(LongType(), False))])

    def make():
        shingler = Shingler(size)

        def step(batch):
            counts, prints, lengths, parts = [], [], [], []
            held: list[np.ndarray] = []

            def flush():
                if held:
                    parts.append(signatures(held).view(np.int64).ravel())
                    held.clear()

            total = 0
            for text in batch.column(2).to_pylist():
                own = shingler.shingles(text)
                counts.append(len(own))
                prints.append(xxh3_128_hexdigest(own.tobytes()) if len(own) else None)
                lengths.append(BANDS if len(own) else 0)
                if len(own):
                    held.append(own)
                    total += len(own)
                    if total > chunk:
                        flush()
                        total = 0
            flush()
            flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            return [batch.column(0), batch.column(1), counts, prints, bands.cast(pa.list_(pa.field("element", pa.int64(), nullable=False)))]

        return step

    text = F.col(text_col).cast("string")
    return map_batches(docs.select(F.col(id_col).cast("long"), F.xxhash64(text), text), schema, make)


def set_test(size: int, percent: int):
    """prepare and alike for Links: Jaccard similarity of whole shingle sets."""

    def make():
        def alike(a: np.ndarray, b: np.ndarray) -> bool:
            common = len(np.intersect1d(a, b, assume_unique=True))
            return 100 * common >= percent * (len(a) + len(b) - common)

        return Shingler(size).shingles, alike

    return make


def shingle_rows(texts: DataFrame, size: int) -> DataFrame:
    """id, shingle: a row for each shingle of each compressed text (bw_id, z)."""

    def run(batches):
        import zstandard

        shingler, unpress = Shingler(size), zstandard.ZstdDecompressor()
        for batch in batches:
            for i, z in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = shingler.shingles(unpress.decompress(z.as_py()).decode("utf-8", "surrogatepass")).view(np.int64)
                for a in range(0, len(own), 100_000):
                    part = own[a : a + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), i, np.int64)), pa.array(part)], names=["id", "shingle"])

    return texts.select("bw_id", "z").mapInArrow(released(run), "id long, shingle long")


def rare_prefixes(rest: DataFrame, codes: DataFrame, links: Links, size: int, percent: int, at: str) -> DataFrame:
    """bucket (a shingle), id, n (size, place, codes), size, comp: the prefixes of the documents in rest.

    Shingles are ordered by how many of these documents have them, rare first.
    Sets that are alike have their first common shingle among the first
    n - ceil(percent * n / 100) + 1 of both; shingles of one document only are
    counted in its places but meet nobody.
    """
    spark = rest.sparkSession
    ids = materialize(spark, rest.groupBy("id").agg(F.first("n").alias("size"), F.first("comp").alias("comp"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k"), at, "rest-docs")
    own = materialize(spark, shingle_rows(links.payload(ids.select(F.col("id").alias("bw_id")), "prefix"), size), at, "shingles")
    counts = own.groupBy("shingle").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    ranked = own.join(counts, "shingle", "left").withColumn("place", F.row_number().over(W.partitionBy("id").orderBy(F.coalesce("c", F.lit(1)), "shingle")))
    ranked = ranked.where("c IS NOT NULL").join(ids, "id").where(f"place <= size - (size * {int(percent)} + 99) div 100 + 1")
    found = ranked.join(codes, "id").select(F.col("shingle").alias("bucket"), "id", F.struct("size", "place", "codes").alias("n"), "size", "comp")
    found = materialize(spark, found, at, "prefixes")
    discard(spark, at, ["shingles"])
    return found


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", size: int = 5, percent: int = 80, rounds: int = 2, with_print: bool = False) -> DataFrame:
    """id_col, n_shingles, component_id, kept for every row of docs.

    Documents are linked where their sets of distinct word shingles (size
    words; the whole sequence where there are fewer) have a Jaccard similarity
    of at least percent; component_id is the smallest id reachable. Null and
    empty texts have no shingles and are linked with nothing. Rows with a null
    id keep a null component and are kept. Rows that repeat an id with another
    text are documents of their own, linked by their own texts. Texts may be of
    any length: one text's shingles are held at a time. Other columns are
    ignored; an empty table gives no rows. with_print adds bw_print, a hash of
    the text, and bw_first, the print of the component's smallest document.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType
    at = stage_dir(spark)
    own = sketches(docs, id_col, text_col, size).withColumn("bw_row", F.monotonically_increasing_id())
    own = materialize(spark, own, at, "sketches")
    # a class is named by one of its rows; nothing relies on ids being distinct
    named = own.where("bw_id IS NOT NULL AND bw_set IS NOT NULL")
    classes = named.groupBy("bw_set").agg(F.min("bw_row").alias("id"), F.first("bw_n").alias("n"), F.first("bw_bands").alias("bands"), F.min(F.struct("bw_id", "bw_print")).alias("low"))
    classes = materialize(spark, classes, at, "classes")
    buckets = shared_buckets(classes.select(F.explode("bands").alias("bucket"), "id", "n"), at)
    codes = classes.select("id", pack_codes([F.get("bands", F.lit(k)) for k in range(BANDS)]).alias("codes"))
    texts = docs.select(F.col(id_col).cast("long").alias("bw_doc"), F.col(text_col).cast("string").alias("bw_text")).withColumn("bw_print", F.xxhash64("bw_text"))
    places = classes.select(F.col("id").alias("bw_id"), F.col("low.bw_id").alias("bw_doc"), F.col("low.bw_print").alias("bw_print"))

    def fetch(ids: DataFrame) -> DataFrame:
        wanted = materialize(spark, places.join(ids, "bw_id", "left_semi"), at, "wanted")
        return texts.join(small(wanted, 2 * ID_BYTES), ["bw_doc", "bw_print"]).select("bw_id", "bw_text")

    fits = F.expr(f"100 * least(n, m) >= {int(percent)} * greatest(n, m)")
    # both sets go on behind the first common shingle by no more than what is left of them
    fine = F.expr(f"100 * least(n.size, m.size) >= {int(percent)} * greatest(n.size, m.size) AND {100 + int(percent)} * (1 + least(n.size - n.place, m.size - m.place)) >= {int(percent)} * (n.size + m.size)")
    fine &= equal_codes(F.col("n.codes"), F.col("m.codes"), BANDS) >= 2
    reach = F.expr(f"{100 + int(percent)} * (1 + n.size - n.place) >= {int(percent)} * (n.size + least)")
    links = Links(spark, fetch, set_test(size, percent), at)
    refine = lambda rest: rare_prefixes(rest, codes, links, size, percent, at)
    comps = link_in_buckets(buckets, fits, links, at, 2, refine, fine, reach, rounds)
    linked = classes.select("id", "low").join(small(comps.select(F.col("node").alias("id"), "component"), ID_BYTES), "id")
    linked = materialize(spark, linked, at, "linked")
    lows = materialize(spark, linked.groupBy("component").agg(F.min("low").alias("least")), at, "lows")
    # a component may hold most of the linked classes
    least = materialize(spark, linked.join(small(lows, 2 * ID_BYTES), "component").select("id", "least"), at, "least")
    reached = classes.select("bw_set", "id", "low").join(small(least, 2 * ID_BYTES), "id", "left").select("bw_set", F.coalesce("least", "low").alias("bw_least"))
    reached = materialize(spark, reached, at, "reached")
    discard(spark, at, keep=("sketches", "reached"))
    joined = own.select("bw_id", "bw_n", "bw_set", "bw_print").join(reached, "bw_set", "left")
    component = F.when(F.col("bw_id").isNotNull(), F.coalesce("bw_least.bw_id", "bw_id"))
    more = [F.col("bw_print"), F.when(F.col("bw_id").isNotNull(), F.coalesce("bw_least.bw_print", "bw_print")).alias("bw_first")] if with_print else []
    return joined.select(F.col("bw_id").cast(kind).alias(id_col), F.col("bw_n").alias("n_shingles"), component.cast(kind).alias("component_id"), F.coalesce(F.col("bw_id") == component, F.lit(True)).alias("kept"), *more)


def keep_one(docs: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """The rows of docs without near duplicates of an earlier document, with their columns.

    Of each group the document with the smallest id, then the smallest hash of
    its text, stays. Rows that repeat both id and text are one document, of
    which one row stays, by the order of a hash of all its columns. Rows with a
    null id all stay. Nothing else goes: a clean text stays though another text
    has its id.
    """
    spark, at = docs.sparkSession, stage_dir(docs.sparkSession)
    found = near_duplicates(docs, id_col, text_col, with_print=True, **options)
    gone = found.where(F.col(id_col).isNotNull() & ~(F.col("kept") & F.col("bw_print").eqNullSafe(F.col("bw_first"))))
    gone = materialize(spark, gone.select(F.col(id_col).alias("bw_gone"), "bw_print").distinct(), at, "gone")
    same = (docs[id_col] == F.col("bw_gone")) & F.xxhash64(docs[text_col].cast("string")).eqNullSafe(F.col("bw_print"))
    kept = docs.join(small(gone, 2 * ID_BYTES), same, "left_anti")
    pairs = docs.select(F.col(id_col).alias("i"), F.xxhash64(F.col(text_col).cast("string")).alias("p")).where("i IS NOT NULL").groupBy("i", "p").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1)
    if pairs.isEmpty():
        return kept
    marked = kept.select("*", F.xxhash64(F.col(text_col).cast("string")).alias("bw_print"), F.xxhash64(*[F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))]).alias("bw_all"))
    first = marked.withColumn("bw_k", F.row_number().over(W.partitionBy(id_col, "bw_print").orderBy("bw_all"))).where((F.col("bw_k") == 1) | F.col(id_col).isNull())
    return first.drop("bw_print", "bw_all", "bw_k")
