"""Line dedup by an edit join of lines over segments.

Two strings within edit distance t share one of the t + 1 segments of the
shorter, at a place within t of its own. So every line is cut into t + 1
segments for its own length (what it offers), and looks up, for every length up
to t less than its own, the substrings that can match such a segment at the
places that a multi-match-aware window leaves. Lines that meet in a substring
are compared by a bit-parallel edit distance over the band of 2t + 1 diagonals.
"""

from __future__ import annotations

from collections.abc import Callable
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .blocking import ID_BYTES, Links, link_in_buckets, shared_buckets
from .common import BROADCAST_BYTES, discard, map_batches, materialize, small, stage_dir
from .rolling import CHUNK, code_points, long_hash, scatter, span_hashes


def segments(length: int, t: int) -> list[tuple[int, int]]:
    """(start, size) of the t + 1 segments of strings of this length; the later ones take the rest."""
    size, rest = divmod(length, t + 1)
    out, at = [], 0
    for i in range(t + 1):
        own = size + (i >= t + 1 - rest)
        out.append((at, own))
        at += own
    return out


def probes(length: int, t: int) -> list[tuple[int, int, int, int]]:
    """(other length, segment, start, size) of the substrings that a string of this length looks up.

    With d the difference in length, segment i (from 0) of the other string can
    only stand at p - i .. p + i as counted from the left, and at
    p + d - (t - i) .. p + d + (t - i) as counted from the right; the window is
    where both hold.
    """
    out = []
    for other in range(max(length - t, t + 1), length + 1):
        d = length - other
        for i, (p, size) in enumerate(segments(other, t)):
            low = max(0, p - i, p + d - (t - i))
            high = min(length - size, p + i, p + d + (t - i))
            out += [(other, i, start, size) for start in range(low, high + 1)]
    return out


def within(a: str, b: str, t: int) -> bool:
    """Whether the edit distance of a and b is at most t.

    Column by column over b, the vertical differences of the 2t + 1 cells
    around the diagonal are held in two numbers, bit 0 the topmost cell. Cells
    beyond the band only ever count as farther.
    """
    if abs(len(a) - len(b)) > t:
        return False
    if a == b:
        return True
    head = len(commonprefix((a, b)))
    a, b = a[head:], b[head:]
    tail = len(commonprefix((a[::-1], b[::-1])))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    m, n = len(a), len(b)
    limit = t + abs(m - n)  # a diagonal's values never fall, and its end is that far from the last cell
    width = 2 * t + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    down, up = full ^ ((1 << (t + 1)) - 1), (1 << (t + 1)) - 1  # differences +1 and -1
    where: dict[str, int] = {}
    for i in range(min(t, m)):
        where[a[i]] = where.get(a[i], 0) | 1 << (i + t + 1)
    at: dict[str, int] = {c: x for c, x in where.items()}  # bits of the rows in the band, for the column before
    distance = 0
    for j in range(n):
        at = {c: x >> 1 for c, x in at.items() if x > 1}
        if j + t < m:
            at[a[j + t]] = at.get(a[j + t], 0) | top
        same = at.get(b[j], 0) & full
        vp, vn = down >> 1 | top, up >> 1
        d0 = (((same & vp) + vp) ^ vp | same | vn) & full
        hp, hn = (vn | ~(d0 | vp)) & full, d0 & vp
        hp, hn = (hp << 1 | 1) & full, hn << 1 & full
        down, up = (hn | ~(d0 | hp)) & full, d0 & hp
        distance += not d0 >> t & 1
        if distance > limit:
            return False
    for b_, sign in ((range(n + 1, m + 1), 1), (range(m + 1, n + 1), -1)):
        for i in b_:
            k = i - n + t
            distance += sign * ((down >> k & 1) - (up >> k & 1))
    return distance <= t


def parities(text: str, longs: int = 2) -> tuple[int, ...]:
    """Which of 64 * longs classes of neighbouring character pairs occur an odd number of times; longs is a power of two.

    One edit takes away or adds at most four pairs, so the prints of lines
    within distance t differ in at most 4 * t bits.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    size = 64 * longs
    classes = (codes[:-1] * np.uint32(0x9E3779B1) + codes[1:] * np.uint32(0x85EBCA77)) >> np.uint32(33 - size.bit_length())
    odd = np.packbits(np.bincount(classes, minlength=size).astype(np.uint8) & 1)
    return tuple(odd.view(np.int64).tolist())


def odd_letters(text: str) -> int:
    """Which of 64 classes of characters occur an odd number of times; one edit changes at most two."""
    codes = code_points(text)
    return int(np.packbits(np.bincount((codes * np.uint32(0x9E3779B1)) >> np.uint32(26), minlength=64).astype(np.uint8) & 1).view(np.int64)[0])


def edit_test(t: int):
    def make():
        return lambda text: text, lambda a, b: within(a, b, t)

    return make


#: The fixed set of characters that are cut off both ends of a line.
BLANK = " \t\x0b\x0c\r"


class Prober:
    """Hashed substrings of lines, offered and looked up, for many lines at once."""

    def __init__(self, t: int):
        self.t, self.plans = t, {}

    def plan(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, sizes and tags (other length and segment) of the substrings of a line of n code points."""
        found = self.plans.get(n)
        if found is None:
            if len(self.plans) > 5000:
                self.plans.clear()
            # what is offered is also looked up, at the line's own length and place
            other, segment, start, size = np.array(probes(n, self.t), dtype=np.int64).T
            found = self.plans[n] = start, size, ((other * (self.t + 1) + segment) * 0x2545F4914F6CDD1D).astype(np.uint64)
        return found

    def buckets(self, bodies: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of all bodies, and the number of the body that each belongs to."""
        hashes, tags, owners, held, total = [], [], [], [], 0

        def flush():
            nonlocal total
            if not held:
                return
            codes = code_points("".join([bodies[k] for k in held]))
            plans = [self.plan(len(bodies[k])) for k in held]
            counts = [len(p[0]) for p in plans]
            starts = np.repeat(np.cumsum([0, *[len(bodies[k]) for k in held[:-1]]]), counts) + np.concatenate([p[0] for p in plans])
            ends = starts + np.concatenate([p[1] for p in plans])
            hashes.append(span_hashes(codes, starts, ends))
            tags.append(np.concatenate([p[2] for p in plans]))
            owners.append(np.repeat(held, counts))
            held.clear()
            total = 0

        for k, body in enumerate(bodies):
            if len(body) > CHUNK:
                start, size, tag = self.plan(len(body))
                codes = code_points(body)
                hashes.append(np.array([long_hash(codes[a : a + n]) for a, n in zip(start.tolist(), size.tolist())], dtype=np.uint64))
                tags.append(tag)
                owners.append(np.full(len(tag), k))
                continue
            if total + len(body) > CHUNK:
                flush()
            held.append(k)
            total += len(body)
        flush()
        if not hashes:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return scatter(np.concatenate(hashes) + np.concatenate(tags)).view(np.int64), np.concatenate(owners)


def bodies_of(text: str | None, least: int) -> list[tuple[int, str]]:
    """(line number, line without blanks at its ends) of the lines of at least so many code points."""
    return [(i, b) for i, x in enumerate(text.split("\n")) if len(b := x.strip(BLANK)) >= least] if text else []


def names_of(bodies: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each line: a name of 63 bits or fewer, and one that tells lines of one name apart."""
    both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(b.encode("utf-8", "surrogatepass")) for b in bodies]), dtype="<i8").reshape(-1, 2)
    return both[:, 0] & ((1 << bits) - 1), both[:, 1]


def with_print(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.where(text.isNotNull()).select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("print"), text.alias("text"))


def from_lines(rows: DataFrame, least: int, bits: int, make: Callable, fields: list[StructField], placed: bool = True) -> DataFrame:
    """The columns that make()'s function gives for the lines of a batch of rows (doc, print, text), if placed after doc and print.

    The function gets lists of line numbers and bodies and their two names, and
    returns for each of its output rows the number of the line, and the columns.
    """
    kind = rows.schema["doc"].dataType
    schema = StructType([*[StructField("doc", kind), StructField("print", LongType())] * placed, *fields])

    def build():
        run = make()

        def step(batch):
            owner, numbers, bodies = [], [], []
            for k, text in enumerate(batch.column(2).to_pylist()):
                found = bodies_of(text, least)
                owner += [k] * len(found)
                numbers += [x[0] for x in found]
                bodies += [x[1] for x in found]
            if not bodies:
                return [pa.array([], type=f.type) for f in to_arrow_schema(schema)]
            lines, columns = run(numbers, bodies, *names_of(bodies, bits))
            if not placed:
                return columns
            places = pa.array(np.array(owner)[lines])
            return [batch.column(0).take(places), batch.column(1).take(places), *columns]

        return step

    return map_batches(rows, schema, build)


def line_names(rows: DataFrame, least: int, bits: int) -> DataFrame:
    """doc, print, line, id, g of all lines."""

    def make():
        return lambda numbers, bodies, h, g: (np.arange(len(bodies)), [np.array(numbers, dtype=np.int32), h, g])

    return from_lines(rows, least, bits, make, [StructField("line", IntegerType()), StructField("id", LongType()), StructField("g", LongType())])


def probe_rows(rows: DataFrame, t: int, least: int, bits: int, placed: bool, told: bool) -> DataFrame:
    """bucket, id, if told g: the buckets of all lines, if placed after doc and print."""

    def make():
        prober = Prober(t)

        def run(numbers, bodies, h, g):
            buckets, lines = prober.buckets(bodies)
            return lines, [buckets, h[lines], *[g[lines]] * told]

        return run

    fields = [StructField("bucket", LongType()), StructField("id", LongType()), *[StructField("g", LongType())] * told]
    return from_lines(rows, least, bits, make, fields, placed)


def line_texts(rows: DataFrame, least: int, bits: int) -> DataFrame:
    """doc, print, id, g, body of all lines."""

    def make():
        return lambda numbers, bodies, h, g: (np.arange(len(bodies)), [h, g, bodies])

    return from_lines(rows, least, bits, make, [StructField("id", LongType()), StructField("g", LongType()), StructField("body", StringType())])


def line_prints(lines: DataFrame) -> DataFrame:
    """id, n: length, parities and odd letters of each line (bw_id, bw_text)."""
    schema = StructType([StructField(c, LongType()) for c in ("id", "len", "low", "high", "odd")])

    def make():
        def step(batch):
            bodies = batch.column(1).to_pylist()
            found = [parities(b) for b in bodies]
            return [batch.column(0), [len(b) for b in bodies], [p[0] for p in found], [p[1] for p in found], [odd_letters(b) for b in bodies]]

        return step

    return map_batches(lines.select("bw_id", "bw_text"), schema, make).select("id", F.struct("len", "low", "high", "odd").alias("n"))


#: What a letter's code is multiplied by before it is dealt to a group, so that frequent letters fall into different ones.
DEAL = np.uint32(0x33EF6283)
#: Code points of two groups that tell lines apart wherever they stand; fewer do so inside a bucket.
ENOUGH = 12
#: Longs of the print of a line that is listed in pairs.
LONGS = 8


def group_pairs(t: int) -> list[tuple[int, int]]:
    """Pairs of 2 * t + 3 groups of letters, of which two lines within distance t agree in one at least.

    An edit concerns the letters of two groups at most, so three groups at least
    keep what a line holds of their letters, in order. The groups are in two
    sets, and two of any three are in the same.
    """
    groups, half = 2 * t + 3, t + 2
    return [(i, j) for i in range(groups) for j in range(i + 1, groups) if (i < half) == (j < half)]


def projections(text: str, t: int) -> tuple[list[int], list[int]]:
    """Hashes of what a line holds of the letters of each of group_pairs(t): those of ENOUGH code points, and the others."""
    codes = code_points(text)
    group = (codes * DEAL >> np.uint32(8)) % np.uint32(2 * t + 3)
    wide, narrow = [], []
    for k, (i, j) in enumerate(group_pairs(t)):
        held = codes[(group == i) | (group == j)]
        digest = xxhash.xxh3_64_intdigest(held.tobytes(), seed=k)
        (wide if len(held) >= ENOUGH else narrow).append(digest - (1 << 64) if digest >> 63 else digest)
    return wide, narrow


def line_projections(lines: DataFrame, t: int) -> DataFrame:
    """id, wide, narrow, n: the projections of each line (bw_id, bw_text), and its length, longer parities and odd letters."""
    kind, parts = ArrayType(LongType()), [f"p{k}" for k in range(LONGS)]
    schema = StructType([StructField("id", LongType()), StructField("wide", kind), StructField("narrow", kind), *[StructField(c, LongType()) for c in ("len", "odd", *parts)]])

    def make():
        def step(batch):
            bodies = batch.column(1).to_pylist()
            found = [projections(b, t) for b in bodies]
            prints = [(len(b), odd_letters(b), *parities(b, LONGS)) for b in bodies]
            return [batch.column(0), [x[0] for x in found], [x[1] for x in found], *map(list, zip(*prints))]

        return step

    return map_batches(lines.select("bw_id", "bw_text"), schema, make).select("id", "wide", "narrow", F.struct("len", "odd", *parts).alias("n"))


def close_prints(t: int, parts: list[str]) -> str:
    """SQL for: lines with the prints n and m, of these longs, can be within distance t."""
    bits = " + ".join(f"bit_count(n.{p} ^ m.{p})" for p in parts)
    return f"abs(n.len - m.len) <= {int(t)} AND bit_count(n.odd ^ m.odd) <= {2 * int(t)} AND {bits} <= {4 * int(t)}"


def by_projections(rest: DataFrame, texts: DataFrame, t: int, at: str) -> DataFrame:
    """bucket, id, n, size, comp: the lines of rest by their projections, each line once however many buckets it is in.

    Projections that are too short to tell lines apart count inside a bucket
    only. n is the longer print, as many lines a few edits beyond t may meet.
    """
    held = texts.join(rest.select(F.col("id").alias("bw_id")).distinct(), "bw_id", "left_semi")
    cuts = materialize(rest.sparkSession, line_projections(held, t), at, "projections")
    lines = rest.select("id", "comp").dropDuplicates(["id"]).join(cuts.select("id", "n", "wide"), "id")
    wide = lines.select(F.explode("wide").alias("bucket"), "id", "n", "comp")
    short = rest.select("bucket", "id", "comp").join(cuts.where(F.size("narrow") > 0).select("id", "n", "narrow"), "id")
    short = short.select("bucket", F.explode("narrow").alias("key"), "id", "n", "comp")
    both = wide.unionAll(short.select(F.xxhash64("bucket", "key").alias("bucket"), "id", "n", "comp"))
    return both.select("bucket", "id", "n", F.col("n.len").alias("size"), "comp")


def told_apart(names: DataFrame, at: str) -> tuple[DataFrame, DataFrame | None]:
    """id, c of the names that several lines have; and, where different lines share one, id, g, new: other names for them.

    New names are negative, which no hash is.
    """
    spark = names.sparkSession
    several = names.groupBy("id").agg(F.min("g").alias("a"), F.max("g").alias("b"), F.count(F.lit(1)).alias("c")).where("c > 1")
    several = materialize(spark, several, at, "names")
    clash = several.where("a <> b").select("id")
    if clash.isEmpty():
        return several.select("id", "c"), None
    each = materialize(spark, names.join(clash, "id", "left_semi").groupBy("id", "g").agg(F.count(F.lit(1)).alias("c")).withColumn("new", -1 - F.monotonically_increasing_id()), at, "renamed")
    alike = several.where("a = b").select("id", "c").unionAll(each.where("c > 1").select(F.col("new").alias("id"), "c"))
    return alike, each.select("id", "g", "new")


def renamed(rows: DataFrame, new: DataFrame | None) -> DataFrame:
    """rows (id, g, ...) with the new names, without g; without new names rows need no g."""
    if new is None:
        return rows.drop("g")
    return rows.join(small(new, ID_BYTES), ["id", "g"], "left").withColumn("id", F.coalesce("new", "id")).drop("g", "new")


def line_links(rows: DataFrame, new: DataFrame | None, t: int, least: int, bits: int, rounds: int, at: str) -> DataFrame:
    """node, component of the lines of at least so many code points that are within t edits of another."""
    spark = rows.sparkSession
    probed = lambda placed: renamed(probe_rows(rows, t, least, bits, placed, new is not None), new)
    buckets = shared_buckets(probed(True), at, counted=probed(False))
    # each line that shares a bucket is written once, from one document that has it
    places = buckets.groupBy("id").agg(F.min(F.struct("doc", "print")).alias("p")).select("id", "p.doc", "p.print")
    places = materialize(spark, places, at, "places")
    sources = places.select(F.col("doc").alias("d"), F.col("print").alias("p")).distinct()
    held = rows.join(small(sources, 2 * ID_BYTES), F.col("doc").eqNullSafe(F.col("d")) & (F.col("print") == F.col("p")), "left_semi")
    texts = renamed(line_texts(held, least, bits), new).join(places.select("id"), "id", "left_semi")
    texts = materialize(spark, texts.select(F.col("id").alias("bw_id"), F.col("body").alias("bw_text")).dropDuplicates(["bw_id"]), at, "texts")
    buckets = buckets.select("bucket", "id", "c").distinct().join(line_prints(texts), "id")
    buckets = materialize(spark, buckets, at, "printed")
    close, closer = (F.expr(close_prints(t, parts)) for parts in (["low", "high"], [f"p{k}" for k in range(LONGS)]))
    links = Links(spark, lambda ids: texts.join(ids, "bw_id", "left_semi"), edit_test(t), at)
    return link_in_buckets(buckets, close, links, at, 1, lambda rest: by_projections(rest, texts, t, at), closer, rounds=rounds)


def repeated_lines(docs: DataFrame, id_col: str, text_col: str, t: int, edit_chars: int, least: int, rounds: int, at: str, bits: int = 63) -> DataFrame:
    """doc, print, drop: the numbers of the lines that repeat an earlier line, for documents that have any.

    Lines are named by 63 bits of a hash; the few whose name another line has
    too, as 64 more bits tell, get other names.
    """
    spark = docs.sparkSession
    rows = with_print(docs, id_col, text_col)
    names = line_names(rows, least, bits)
    several, new = told_apart(names, at)
    comps = line_links(rows, new, t, max(edit_chars, least), bits, rounds, at).select(F.col("node").alias("id"), F.col("component").alias("comp"))
    known = several.select("id").join(comps, "id", "full").select("id", F.coalesce("comp", "id").alias("comp"))
    known = materialize(spark, known, at, "known")
    places = materialize(spark, renamed(names, new).join(small(known, ID_BYTES), "id").select("doc", "print", "line", "comp"), at, "repeats")
    firsts = places.groupBy("comp").agg(F.min(F.struct("doc", "print", "line")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    gone = places.join(small(firsts.select("comp", "first"), 2 * ID_BYTES), "comp").where(~F.struct("doc", "print", "line").eqNullSafe(F.col("first")))
    drops = materialize(spark, gone.groupBy("doc", "print").agg(F.collect_set("line").alias("drop")), at, "drops")
    discard(spark, at, keep=("drops",))
    return drops


def dedup_lines(docs: DataFrame, id_col="doc_id", text_col="text", t: int = 2, edit_chars: int = 30, exact_chars: int = 1, rounds: int = 2, limit: int = BROADCAST_BYTES, bits: int = 63) -> DataFrame:
    """The rows of docs with repeated lines cut out of the text, and bw_dropped, how many.

    A line is what stands between line feeds, without blanks at its ends. Lines
    within edit distance t of each other, in any number of steps, are one
    group; its first line, by document id, text and line number, stays and the
    others go. That holds for lines of edit_chars code points or more; shorter
    ones, down to exact_chars, form groups of equal lines, because two edits
    make different short lines equal. Blank lines stay. Null texts stay null;
    null ids come first; rows that repeat id and text count as one document;
    texts and lines may be of any length; other columns are passed on; an empty
    table stays empty.
    """
    if edit_chars <= t:
        raise ValueError("lines of the edit join need more code points than edits")
    drops = repeated_lines(docs, id_col, text_col, t, edit_chars, max(1, exact_chars), rounds, stage_dir(docs.sparkSession), bits)
    bytes_ = drops.agg(F.sum(64 + 8 * F.size("drop"))).first()[0] or 0
    drops = drops.select(F.col("doc").alias("bw_doc"), F.col("print").alias("bw_print"), F.col("drop").alias("bw_drop"))
    if bytes_ <= limit:
        drops = F.broadcast(drops)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("bw_row"), F.col(text_col).cast("string").alias("bw_text"))
    same = F.col(f"bw_row.`{id_col}`").eqNullSafe(F.col("bw_doc")) & (F.xxhash64("bw_text") == F.col("bw_print"))
    joined = packed.join(drops, same, "left")
    cut = F.array_join(F.filter(F.split("bw_text", "\n", -1), lambda x, i: ~F.array_contains("bw_drop", i)), "\n")
    new = F.when(F.col("bw_drop").isNull(), F.col("bw_text")).otherwise(cut).cast(docs.schema[text_col].dataType)
    dropped = F.when(F.col("bw_drop").isNull(), 0).otherwise(F.size("bw_drop")).cast("long")
    return joined.select(*[(new if c == text_col else F.col(f"bw_row.`{c}`")).alias(c) for c in docs.columns], dropped.alias("bw_dropped"))


def dedup_report(docs: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """id_col, text without its repeated lines, n_lines before and n_dropped, one row for each input row."""
    only = docs.select(id_col, text_col, F.coalesce(F.size(F.split(F.col(text_col).cast("string"), "\n", -1)), F.lit(0)).cast("long").alias("bw_lines"))
    out = dedup_lines(only, id_col, text_col, **options)
    return out.select(id_col, text_col, F.greatest("bw_lines", F.lit(0)).alias("n_lines"), F.col("bw_dropped").alias("n_dropped"))
