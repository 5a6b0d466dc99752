"""Secret scans: fixed patterns, and character Markov models for the rest.

All on DataFrame functions. Two first-order character models, of random strings
and of ordinary identifiers, are counted from labelled samples; a candidate is
a secret if the log-likelihood ratio of the two is above a margin a character.
Ratios are kept as whole thousandths, so sums are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import let, materialize, stage_dir

#: Fixed patterns of the base kinds, in their order: kind, pattern, group whose length counts, least length, test worth making first.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""),
    ("access", r"AKIA[A-Z0-9]+", 0, 16, r"AKIA[A-Z0-9]"),
    ("hex", r"[0-9a-f]{32,}", 0, 32, r"[0-9a-f]{32}"),
)
KINDS = ("assign", "access", "hex", "model")
#: Characters that the models tell apart; others share the place 0.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIZE = len(ALPHABET) + 1
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
SPAN = "struct<start:int,kind:int,end:int,value:string>"


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, b: a + b)


def running_sums(lengths: Column) -> Column:
    """Sums of all earlier items, for each item; blocks keep the work below n * sqrt(n)."""

    def blocks(numbers: Column, size: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / size).cast("int")), lambda k: total(F.slice(numbers, k * size + 1, size)))
        return let(sums, lambda s: F.transform(s, lambda x, k: total(F.slice(s, F.lit(1), k))))

    def all_(numbers: Column, size: Column) -> Column:
        return let(blocks(numbers, size), lambda before: F.transform(numbers, lambda x, i: F.get(before, F.floor(i / size).cast("int")) + total(F.slice(numbers, i - i % size + 1, i % size))))

    return let(lengths, lambda numbers: let(F.greatest(F.ceil(F.sqrt(F.size(numbers))).cast("int"), F.lit(1)), lambda size: all_(numbers, size)))


def spans_of(text: Column, pattern: str, group: int, kind: int, hint: str) -> Column:
    """Spans (start, kind, end, value) of the leftmost non-overlapping matches, in code points.

    Splitting by the pattern gives what lies between the matches; the lengths of
    both add up to the places. Texts without the hint are not split.
    """
    pick = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    lengths = F.transform(F.split(text, pattern, -1), F.length)
    pairs = F.arrays_zip(lengths.alias("gap"), F.transform(pick(0), F.length).alias("len"), pick(group).alias("value")).cast("array<struct<gap:int,len:int,value:string>>")
    pairs = F.filter(pairs, lambda x: x["len"].isNotNull())

    def place_all(found: Column) -> Column:
        sums = running_sums(F.transform(found, lambda x: x["gap"] + x["len"]))
        return let(sums, lambda s: F.transform(found, lambda x, i: F.struct((F.get(s, i) + x["gap"]).alias("start"), F.lit(kind).alias("kind"), (F.get(s, i) + x["gap"] + x["len"]).alias("end"), x["value"].alias("value"))))

    return F.when(text.rlike(hint), let(pairs, place_all)).otherwise(F.array().cast(f"array<{SPAN}>")).cast(f"array<{SPAN}>")


def at_least(spans: Column, least: int) -> Column:
    return F.filter(spans, lambda x: F.length(x["value"]) >= least)


def base_spans(df: DataFrame, text: str) -> DataFrame:
    """df with a column bw_<kind> for each base kind, failing matches dropped."""
    for i, (kind, pattern, group, least, hint) in enumerate(BASE):
        spans = spans_of(F.col(text), pattern, group, i, hint)
        df = df.withColumn(f"bw_{kind}", at_least(spans, least))
    return df


def place(character: Column) -> Column:
    return F.call_function("instr", F.lit(ALPHABET), character)


def pairs_of(value: Column) -> Column:
    """Numbers of the neighbouring character pairs of a string."""
    at = F.transform(F.split(value, ""), place)
    return let(at, lambda p: F.transform(F.slice(p, F.lit(1), F.greatest(F.length(value) - 1, F.lit(0))), lambda c, i: c * SIZE + F.get(p, i + 1)))


def train(labelled: DataFrame, value: str = "value", secret: str = "secret") -> list[int]:
    """The ratio table, SIZE * SIZE whole thousandths, from labelled strings.

    Pairs are counted on the executors with one added to each; the rows
    collected are at most two for each pair of characters, whatever the sample.
    """
    counted = labelled.select(F.col(secret).cast("boolean").alias("s"), F.explode(pairs_of(F.col(value))).alias("pair")).groupBy("s", "pair").agg(F.count(F.lit(1)).alias("n"))
    counts = {(r.s, r.pair): r.n for r in counted.collect()}
    import math

    table = []
    rows = {(s, a): sum(counts.get((s, a * SIZE + b), 0) for b in range(SIZE)) + SIZE for s in (True, False) for a in range(SIZE)}
    for a in range(SIZE):
        for b in range(SIZE):
            p, q = ((counts.get((s, a * SIZE + b), 0) + 1) / rows[s, a] for s in (True, False))
            table.append(round(1000 * math.log(p / q)))
    return table


def ratio(value: Column, table: list[int]) -> Column:
    """Summed log-likelihood ratio of a string, in thousandths."""
    known = F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")  # folded to one constant
    return F.aggregate(F.transform(pairs_of(value), lambda k: F.get(known, k)), F.lit(0), lambda a, b: a + b)


def labelled_sample(docs: DataFrame, id_col="doc_id", text_col="text", sample_docs: int = 2000, generated: int = 4000) -> DataFrame:
    """value, secret: the strings that the models are fitted on.

    Secrets: the base matches in the sampled documents, and generated random
    strings in four alphabets. Ordinary: words of the same documents outside
    those matches, alone, and joined two by two as identifiers are. The sample
    is bounded: the sample_docs documents smallest by hash of id.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body")).where("body IS NOT NULL")
    # only ids are sorted and broadcast, at most sample_docs of them
    ids = rows.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(sample_docs)
    some = materialize(spark, rows.join(F.broadcast(ids), "id", "left_semi"), stage_dir(spark), "sample")
    some = base_spans(some, "body")
    secrets = some.select(F.explode(F.concat(*[F.col(f"bw_{k[0]}") for k in BASE])).alias("x")).select("x.value")
    digest = F.sha2(F.col("id").cast("string"), 256)
    plain = F.regexp_replace(F.base64(F.unhex(digest)), "[+/=]", "")
    made = spark.range(generated).select(F.explode(F.array(digest, F.upper(F.substring(digest, 1, 32)), F.base64(F.unhex(digest)), plain, F.concat(F.lit("AKIA"), F.substring(F.upper(plain), 1, 16)))).alias("value"))
    words = some.select(F.filter(F.split("body", r"[^A-Za-z0-9_-]+"), lambda w: (F.length(w) >= 4) & ~w.rlike("[0-9]{3}|[0-9a-f]{32}|AKIA")).alias("w"))
    two = lambda w, i: F.get("w", i + 1)
    joined = F.flatten(F.transform("w", lambda w, i: F.array(w, F.concat(F.lower(w), F.lit("_"), F.lower(F.coalesce(two(w, i), w))), F.concat(F.lower(w), F.initcap(F.coalesce(two(w, i), w))), F.concat(F.upper(w), F.lit("_"), F.upper(F.coalesce(two(w, i), w))), F.concat(F.lit("/"), F.lower(w), F.lit("-"), F.lower(F.coalesce(two(w, i), w))))))
    ordinary = words.select(F.explode(joined).alias("value"))
    return secrets.unionAll(made).select("value", F.lit(True).alias("secret")).unionAll(ordinary.select("value", F.lit(False).alias("secret")))


def find_secrets(docs: DataFrame, table: list[int], id_col="doc_id", text_col="text", margin: int = 300) -> DataFrame:
    """Every row of docs with its spans, as arrays of structs.

    id_col, bw_text, bw_base (base spans in order) and bw_model: candidates
    that overlap no base span and whose ratio is above margin thousandths a
    character.
    """
    df = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("bw_text"))
    df = base_spans(df, "bw_text").withColumn("bw_base", F.array_sort(F.concat(*[F.col(f"bw_{k[0]}") for k in BASE])))
    df = df.withColumn("bw_cand", spans_of(F.col("bw_text"), CANDIDATE, 0, len(BASE), CANDIDATE[:-2] + "}"))
    apart = lambda x: ~F.exists("bw_base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    random = lambda x: ratio(x["value"], table) > margin * F.length(x["value"])
    return df.withColumn("bw_model", F.filter("bw_cand", lambda x: random(x) & apart(x)))


def scan(docs: DataFrame, table: list[int], id_col="doc_id", **options) -> DataFrame:
    """id_col, n_assign, n_access, n_hex, base_sha256, spans, n_model, one row for each input row.

    Null texts count as empty and have no spans; repeated rows are each
    scanned; other columns are ignored; an empty table gives no rows.
    """
    df = find_secrets(docs, table, id_col, **options)
    names = F.array(*[F.lit(k) for k in KINDS])
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")
    return df.select(
        id_col,
        *[F.size(f"bw_{k[0]}").cast("long").alias(f"n_{k[0]}") for k in BASE],
        F.sha2(text(F.col("bw_base")), 256).alias("base_sha256"),
        text(F.array_sort(F.concat("bw_base", "bw_model"))).alias("spans"),
        F.size("bw_model").cast("long").alias("n_model"),
    )
