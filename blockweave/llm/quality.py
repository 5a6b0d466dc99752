"""Quality rules with thresholds that adapt to language and source.

All on DataFrame functions. Each document gets its counts in one pass. A
log-linear histogram sketch of every metric is kept for each language and
source: a value's bucket is its leading bits, so sketches merge by adding
counts, quantiles are off by one part in 128 at most, and the result does not
depend on the order of merging. Thresholds are read off the sketches and joined
back to the documents.

No threshold is a fixed number. A metric is a rate, such as symbols a
character. Its bounds lie WIDTH times the distance from the lower quartile to
the median away from the median: half of a group may be junk before its bounds
move far. Small groups are drawn towards all documents, in proportion to their
size. A document's own count may leave the bounds by what chance explains at
its length, Z standard deviations of a Poisson count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from .common import BROADCAST_BYTES, materialize, small, stage_dir

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Metric -> (count, out of, what one event adds to the count, whether there is a lower bound too); rates are kept per mille.
#: The smallest repeat, a window of three words found twice, makes six repeated words.
RULES = {
    "symbol_pm": ("n_symbols", "word_chars", 1, False),
    "word_len_pm": ("word_chars", "n_words", 1, True),
    "dup_line_pm": ("n_dup_lines", "bw_n_lines", 1, False),
    "repeat_pm": ("n_repeat_words", "n_words", 6, False),
}
#: How many distances from the lower quartile to the median a bound is away from the median.
WIDTH = 8
#: Standard deviations of chance that a count may have besides.
Z = 4
#: All documents count as so many documents of each group.
PRIOR = 50
#: Leading bits that a bucket keeps.
BITS = 7


def base_counts(docs: DataFrame, id_col="doc_id", text_col="text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, the columns in keep, n_words and the base counts of every whole text.

    The repeated three-word windows are found inside the row: hashes of all
    windows are sorted together with their places, neighbours that are equal
    mark repeated places, and the union of their three words is summed from the
    gaps between marked places.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(*[F.col(f"`{c}`").alias(f"bw_{i}") for i, c in enumerate((id_col, *keep))], text.alias("bw_text"))
    rows = rows.withColumn("bw_words", F.filter(F.split("bw_text", SPACE, -1), lambda w: w != ""))
    rows = rows.withColumn("bw_lines", F.filter(F.split("bw_text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    word = lambda i: F.get("bw_words", i)
    places = F.when(F.size("bw_words") >= 3, F.transform(F.sequence(F.lit(0), F.size("bw_words") - 3), lambda i: F.struct(F.xxhash64(word(i), word(i + 1), word(i + 2)).alias("h"), i.alias("i"))))
    rows = rows.withColumn("bw_sorted", F.sort_array(F.coalesce(places, F.array().cast("array<struct<h:bigint,i:int>>"))))
    at = lambda i: F.get("bw_sorted", i)["h"]
    marked = F.transform(F.filter("bw_sorted", lambda x, i: (x["h"] == F.coalesce(at(i - 1), F.bitwise_not(x["h"]))) | (x["h"] == F.coalesce(at(i + 1), F.bitwise_not(x["h"])))), lambda x: x["i"])
    rows = rows.withColumn("bw_marked", F.sort_array(marked))
    gaps = F.transform("bw_marked", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("bw_marked", i + 1), p + 3) - p))
    return rows.select(
        F.col("bw_0").alias(id_col),
        *[F.col(f"bw_{i}").alias(c) for i, c in enumerate(keep, 1)],
        F.size("bw_words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("bw_text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("bw_text") - F.length(F.translate("bw_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("bw_lines") - F.size(F.array_distinct("bw_lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(gaps, F.lit(0), lambda a, b: a + b).cast("long").alias("n_repeat_words"),
        F.size("bw_lines").cast("long").alias("bw_n_lines"),
    )


def with_verdict(counts: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    metrics = {m: F.expr(f"{count} * 1000 div greatest({of}, 1)") for m, (count, of, _, _) in RULES.items()}
    return counts.select("*", failed.alias("base_failed"), *[v.alias(f"bw_{k}") for k, v in metrics.items()])


def bucket(value: Column) -> Column:
    """The value with all but its leading bits cleared: exact below 2**BITS."""
    shift = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(judged: DataFrame, groups: list[str]) -> DataFrame:
    """Mergeable sketches: groups, metric, bucket, n. Rows that fail the base rules are left out.

    A row for each group, metric and bucket: at most a few hundred buckets a
    metric however many documents there are.
    """
    pairs = F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), bucket(F.col(f"bw_{m}")).alias("bucket")) for m in RULES]))
    return judged.where("NOT base_failed").select(*groups, pairs).groupBy(*groups, "metric", "bucket").agg(F.count(F.lit(1)).alias("n"))


def thresholds(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """Groups, then lo and hi for each metric, read off the sketches.

    The quantile is the first bucket whose running count reaches q * total.
    """
    keys = [*groups, "metric"]
    running = sketch.withColumn("upto", F.sum("n").over(W.partitionBy(*keys).orderBy("bucket"))).withColumn("total", F.sum("n").over(W.partitionBy(*keys)))

    def quantile(metric: str, percent: int) -> Column:
        return F.min(F.when((F.col("metric") == metric) & (F.col("upto") * 100 >= F.col("total") * percent), F.col("bucket")))

    aggs = [F.max("total").alias("bw_total")]
    for m, (_, _, _, low) in RULES.items():
        middle, spread = quantile(m, 50), quantile(m, 50) - quantile(m, 25)
        aggs.append((middle + WIDTH * spread).alias(f"hi_{m}"))
        if low:
            aggs.append(F.greatest(middle - WIDTH * spread, F.lit(0)).alias(f"lo_{m}"))
    return running.groupBy(*groups).agg(*aggs)


def bounds_of(judged: DataFrame, groups: list[str]) -> DataFrame:
    """The thresholds of every group, drawn towards those of all documents as if these were PRIOR documents more."""
    sketch = sketches(judged, groups)
    own = thresholds(sketch, groups)
    merged = sketch.withColumn("bw_all", F.lit(0)).groupBy("bw_all", "metric", "bucket").agg(F.sum("n").alias("n"))
    names = [c for c in own.columns if c.startswith(("hi_", "lo_"))]
    overall = thresholds(merged, ["bw_all"]).select("bw_all", *[F.col(c).alias(f"all_{c}") for c in names])
    both = own.withColumn("bw_all", F.lit(0)).join(overall, "bw_all")
    return both.select(*groups, *[F.expr(f"(bw_total * {c} + {PRIOR} * all_{c}) div (bw_total + {PRIOR})").alias(c) for c in names])


def inside() -> Column:
    """Whether the counts of a document lie within the bounds of its group and what chance adds."""
    fits = F.lit(True)
    for m, (count, of, unit, low) in RULES.items():
        k, n = F.col(count) * F.lit(1000.0), F.col(of).cast("double")
        high = F.col(f"hi_{m}")
        fits &= k <= high * n + Z * F.sqrt(F.lit(1000.0 * unit) * high * n) + 1000.0 * unit * Z * Z
        if low:
            fits &= k >= F.col(f"lo_{m}") * n - Z * F.sqrt(F.lit(1000.0 * unit) * F.col(f"lo_{m}") * n)
    return fits


def judge(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", source_col="source", keep: tuple[str, ...] = (), limit: int = BROADCAST_BYTES) -> DataFrame:
    """Counts, base_failed and kept for every row of docs, with the columns in keep.

    kept is false where a base rule fails or a count leaves the thresholds of
    its language and source. Null languages and sources form groups of their
    own; null texts have no words and fail; repeated rows are each judged;
    texts may be of any length (a text's words are held at a time); an empty
    table gives an empty result.

    The counts, with the columns in keep, are written to the shared folder, so
    that the texts are gone through once. The thresholds, one row a group, are
    broadcast up to a checked size; beyond, the join shuffles.
    """
    spark, groups = docs.sparkSession, ["bw_lang", "bw_source"]
    group = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00"))
    inputs = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys((id_col, text_col, *keep))], group(lang_col).alias(groups[0]), group(source_col).alias(groups[1]))
    judged = with_verdict(base_counts(inputs, id_col, text_col, keep=(*[c for c in keep if c != id_col], *groups)))
    at = stage_dir(spark)
    judged = materialize(spark, judged, at, "counts")
    own = materialize(spark, bounds_of(judged, groups), at, "thresholds")
    joined = judged.join(small(own, 200, limit), groups, "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside(), F.lit(True)))


def quality(docs: DataFrame, id_col="doc_id", **columns) -> DataFrame:
    """id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    return judge(docs, id_col, **columns).select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, **columns) -> DataFrame:
    """The rows of docs that judge() keeps, with the columns they came with.

    Rows that repeat are each kept or not, alike; an empty table stays empty.
    """
    packed = docs.withColumn("bw_row", F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    kept = judge(packed, keep=("bw_row",), **columns).where("kept")
    return kept.select(*[F.col(f"bw_row.`{c}`").alias(c) for c in docs.columns])
