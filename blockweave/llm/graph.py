"""Connected components over edge tables that never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, materialize, stage_dir


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, at: str, name: str) -> DataFrame:
    """One round. Each node hangs its neighbours on the smallest node it sees.

    The minima are written first, so that the join reads two shuffles and a hub
    with very many neighbours can be split over tasks.
    """
    spark = edges.sparkSession
    around = _both(edges)
    minima = materialize(spark, around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), at, f"{name}-large")
    large = around.join(minima, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    down = materialize(spark, large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), at, f"{name}-down")
    minima = materialize(spark, down.groupBy("a").agg(F.min("b").alias("m")), at, f"{name}-small")
    hung = down.join(minima, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return materialize(spark, hung.unionAll(minima.select("a", F.col("m").alias("b"))).distinct(), at, name)


def _is_forest(edges: DataFrame) -> bool:
    """Whether every edge hangs a node on a root: no node hangs twice, no root hangs itself."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("low"), F.lit(0).alias("top")).unionAll(edges.select(F.col("b").alias("x"), F.lit(0).alias("low"), F.lit(1).alias("top")))
    per = ends.groupBy("x").agg(F.sum("low").alias("low"), F.max("top").alias("top"))
    return not per.agg(F.bool_or((F.col("low") > 1) | ((F.col("low") > 0) & (F.col("top") > 0)))).first()[0]


def components(edges: DataFrame, at: str | None = None, name: str = "components") -> DataFrame:
    """node, component (its smallest reachable node) for all nodes of edges (a, b).

    Alternates the two star operations until the edges form stars, which takes
    rounds in the order of the logarithm of the longest path. Every round is
    written to the shared folder and the one before it deleted; only a yes or no
    reaches the driver. Null ends and loops are ignored; an empty table gives
    no rows.
    """
    spark, at = edges.sparkSession, at or stage_dir(edges.sparkSession)
    clean = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now, k = materialize(spark, clean.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), at, f"{name}-0"), 0
    while not _is_forest(now):
        k += 1
        now = _star(now, at, f"{name}-{k}")
        discard(spark, at, [f"{name}-{k - 1}", *[f"{name}-{k}-{x}" for x in ("large", "down", "small")]])
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
