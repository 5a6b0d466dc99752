"""One query for each text operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, html, lines, minhash, pieces, pii, quality, secrets, sql, token_counts, urls
from .common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), budget=2048)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


def op3_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(secrets.labelled_sample(docs)))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge_urls(pages, urls.rule_table(spark), urls.link_edges(pages))


def url_alias_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The URL filter on pages that are linked: two of three name the page before them as canonical or redirect to it."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    before = pages.select((F.col("page_id") + 1).alias("page_id"), F.col("url").alias("target"))
    link = F.when(F.col("page_id") % 3 == 1, F.concat(F.lit('<link rel="canonical" href="'), "target", F.lit('">')))
    link = link.when(F.col("page_id") % 3 == 2, F.concat(F.lit('<meta http-equiv="refresh" content="0; url='), "target", F.lit('">')))
    linked = pages.join(before, "page_id", "left").select("page_id", "url", F.coalesce(link, F.lit("")).alias("html"))
    return urls.judge_urls(linked, urls.rule_table(spark), urls.link_edges(linked))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return out.drop("longest_match")


#: Stands for a key that a deployment keeps secret.
PSEUDONYM_KEY = b"example key of the test queries"


def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_report(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_near_duplicates,
        op3_sampled_pieces,
        op4_secret_scan,
        op5_url_filter,
        url_alias_chains,
        op6_html_text,
        op7_quality_rules,
        op8_decontamination,
        op9_pseudonyms,
        op10_line_dedup,
    )
}
ORACLE = sql.ORACLE
