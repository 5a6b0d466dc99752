"""A corpus pipeline of the text operators; each stage is written and read again.

All stages but the last keep the columns of documents, take them by name, and
pass other columns on, whatever they are called. Texts may be of any length. An
empty table runs through all stages and stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from blockweave.llm import decontaminate, lines, minhash, pieces, quality
from blockweave.llm.common import materialize, stage_dir, table
from blockweave.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null and empty texts have no words and go; null languages and sources are
    groups of their own; repeated rows go or stay alike.
    """
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line of the corpus are cut out; documents left empty by that go.

    Lines of 30 characters and more count as equal up to two edits, shorter ones
    where they are equal. Documents without repeated lines stay as they are.
    """
    out = lines.dedup_lines(docs)
    return out.where("bw_dropped = 0 OR btrim(text) <> ''").drop("bw_dropped")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) the smallest id stays.

    Rows with a null id stay; of rows that repeat id and text one stays.
    """
    return minhash.keep_one(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents mostly made of them go. An empty benchmark changes nothing."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, pieces and n_pieces of what is left: sampled segmentations that decode to the texts."""
    return pieces.encode(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]
#: Sampling and the similarity joins are not expressed in SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the rows of the last."""
    docs, at = table(spark, sf_dir, "documents"), stage_dir(spark)
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), at, name)
    return STAGES[-1][1](spark, docs, sf_dir)
