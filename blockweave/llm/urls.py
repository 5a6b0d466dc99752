"""URL rules, carried over to aliases along redirects and canonical links."""

from __future__ import annotations

import re
from html import unescape
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .common import discard, map_batches, materialize, small, stage_dir
from .graph import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: action, host and path of the rules.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def with_rules(urls: DataFrame, rules: DataFrame, inline_limit: int = 1000) -> DataFrame:
    """urls (bw_host, bw_path) with rule and action of the longest rule that fits; null if none.

    A rule fits its host and all subdomains where the path starts with its
    path. Rules are unique by host and path. Up to inline_limit of them, which
    is checked, are compared in the row; more are joined on the suffixes of the
    distinct hosts, so that a host with very many urls is looked up once.
    """
    rules = rules.select("action", "host", "path")
    few = rules.limit(inline_limit + 1).collect()
    if len(few) <= inline_limit:
        if not few:
            return urls.select("*", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("action"))
        fits = [F.when(((F.col("bw_host") == r.host) | F.col("bw_host").endswith("." + r.host)) & F.col("bw_path").startswith(r.path), F.struct(F.lit(len(r.host + r.path)).alias("n"), F.lit(r.host + r.path).alias("rule"), F.lit(r.action).alias("action"))) for r in few]
        best = F.array_max(F.array(*fits))
        return urls.select("*", best["rule"].alias("rule"), best["action"].alias("action"))
    parts = F.split("bw_host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    hosts = urls.select("bw_host").distinct().select("bw_host", F.explode(suffixes).alias("host")).join(rules, "host")
    by_host = hosts.groupBy("bw_host").agg(F.collect_list(F.struct(F.length(F.concat("host", "path")).alias("n"), F.concat("host", "path").alias("rule"), "action", "path")).alias("bw_rules"))
    joined = urls.join(by_host, "bw_host", "left")
    best = F.array_max(F.filter("bw_rules", lambda r: F.col("bw_path").startswith(r["path"])))
    return joined.select(*urls.columns, best["rule"].alias("rule"), best["action"].alias("action"))


def key_of(url: Column) -> Column:
    """The url under which pages and links meet: no fragment, scheme and host in lower case."""
    head = F.regexp_extract(url, r"^([^:/?#]+://[^/?#]*)", 1)
    return F.regexp_replace(F.concat(F.translate(head, UPPER, LOWER), F.substring(url, F.length(head) + 1, F.length(url))), "#.*$", "")


def absolute(target: str, base: str) -> str | None:
    """A link of the page at base as an absolute url; None if it is not one of a web page."""
    if SCHEME.match(target):
        return target if "://" in target else None
    own = ORIGIN.match(base)
    if not own:
        return None
    if target.startswith("//"):
        return own[1] + target
    if target.startswith("/") and not DOTS.search(target):
        return own[0] + target
    path = base[own.end() :]
    # joined below a scheme that urljoin knows, whatever the page's own is
    try:
        joined = urljoin(f"http://x{path}", target)
    except ValueError:
        return None
    return own[0] + joined[len("http://x") :]


def links_of(page: str, base: str) -> list[str]:
    """The absolute targets of all canonical links and refresh redirects of a page, in page order."""
    out = []
    for m in TAG.finditer(page):
        found: dict[str, str] = {}
        for name, a, b, c in ATTRIBUTE.findall(m[2]):
            found.setdefault(name.lower(), unescape(a or b or c).strip(BLANK))
        target = None
        if m[1].lower() == "link":
            if "canonical" in found.get("rel", "").lower().split():
                target = found.get("href")
        elif found.get("http-equiv", "").lower() == "refresh":
            refresh = REFRESH.search(found.get("content", ""))
            target = refresh and refresh[1].strip(BLANK)
        url = absolute(target, base) if target else None
        if url:
            out.append(url)
    return out


SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")
ORIGIN = re.compile(r"([^:/?#]+:)//[^/?#]*")
#: Steps to the same or the upper folder.
DOTS = re.compile(r"^[^?#]*/\.\.?(?:[/?#]|$)")
TAG = re.compile(r"""<(link|meta)\b((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*)>""", re.I)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")
REFRESH = re.compile(r"""\burl\s*=\s*["']?([^"']+)""", re.I)
BLANK = " \t\n\r\f"


def link_edges(pages: DataFrame, url_col="url", html_col="html") -> DataFrame:
    """Edges (a, b) between urls: all canonical links and refresh redirects of the pages.

    Attributes may stand in any order; character references are decoded, and
    relative targets are resolved against the url of the page.
    """
    html = F.col(html_col).cast("string")
    some = pages.where(F.col(url_col).isNotNull() & html.rlike(r"(?i)<(?:link|meta)\b")).select(F.col(url_col).cast("string").alias("u"), html.alias("h"))
    schema = StructType([StructField("u", StringType()), StructField("t", ArrayType(StringType()))])

    def make():
        def step(batch):
            return [batch.column(0), [links_of(page, url) for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]]

        return step

    out = map_batches(some, schema, make).select("u", F.explode("t").alias("t"))
    return out.select(key_of(F.col("u")).alias("a"), key_of(F.col("t")).alias("b")).where("a <> b")


def judge_urls(pages: DataFrame, rules: DataFrame, edges: DataFrame, id_col="page_id", url_col="url") -> DataFrame:
    """id_col, host, path, rule, verdict, alias_of for every row of pages.

    The verdict is that of the longest rule that fits. A url without a rule is
    blocked if a url it is an alias of (by redirects and canonical links, in
    any number of steps, fragments and the case of hosts aside) is blocked by a rule; otherwise it is
    allowed. A url's own allow rule stands whatever its aliases are. Null urls
    and urls without :// have empty host and path, no rule and no aliases.
    alias_of is the smallest url of the component, null without edges. Repeated
    rows are each judged, null ids too; urls may be of any length; other columns
    are ignored; an empty table gives no rows.
    """
    spark, at = pages.sparkSession, stage_dir(pages.sparkSession)
    df = pages.select(F.col(id_col), F.col(url_col).cast("string").alias("bw_url"))
    df = with_rules(df.withColumns({"bw_host": host_of(F.col("bw_url")), "bw_path": path_of(F.col("bw_url"))}), rules)
    linked = materialize(spark, components(edges, at, "links"), at, "aliases")
    nodes = with_rules(linked.withColumns({"bw_host": host_of(F.col("node")), "bw_path": path_of(F.col("node"))}), rules)
    blocked = nodes.groupBy("component").agg(F.bool_or(F.coalesce(F.col("action") == "block", F.lit(False))).alias("bw_blocked"))
    aliases = linked.join(blocked, "component").select(F.col("node").alias("bw_key"), F.col("component").alias("alias_of"), "bw_blocked")
    aliases = materialize(spark, aliases, at, "blocked")
    discard(spark, at, keep=("blocked",))
    # few pages have aliases as a rule; null urls and very common ones then need no shuffle
    joined = df.withColumn("bw_key", key_of(F.col("bw_url"))).join(small(aliases, 400), "bw_key", "left")
    verdict = F.coalesce("action", F.when(F.col("bw_blocked"), F.lit("block")), F.lit("allow"))
    return joined.select(id_col, F.col("bw_host").alias("host"), F.col("bw_path").alias("path"), "rule", verdict.alias("verdict"), "alias_of")


def rule_table(spark) -> DataFrame:
    return spark.createDataFrame(list(RULES), "action string, host string, path string")
