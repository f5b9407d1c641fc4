"""URL filters: host-suffix and path-prefix expressions, met by short hash prefixes, confirmed by full digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged

#: A url is hot beyond this share of all rows and this number of rows.
HOT_SHARE, HOT_ROWS = 1e-5, 1000
#: The rules of the query, as (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (after the first ``://`` up to / ? # or the end, A-Z lower-cased) and the path (then up to ? # or the end).
    A null url, or one without ``://``, has both empty."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")


def _digest(host: Column, path: Column) -> Column:
    """The length in front keeps (a.b, /c) and (a.b/, c) apart."""
    return F.sha2(F.concat(F.length(host).cast("string"), F.lit(":"), host, path), 256)


def judge(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", prefix_chars: int = 8, broadcast_rules: int = 1_000_000) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    Distinct (host, path) pairs are expanded once into the host suffixes of as many labels as some rule has, each with the
    path prefixes whose length some rule has: so a url gives as many expressions as the rules have shapes, however long
    it is. Expressions meet the rules on the first ``prefix_chars`` hex digits of their SHA-256; the full digest
    confirms. Of the rules that fit, the longest wins (host and path together; then the longer host; then block). Rules
    are broadcast only when they number ``broadcast_rules`` at most; else the join shuffles both sides. Outcomes are
    staged and go back to the rows: those of hot urls (of over ``HOT_SHARE`` of all rows, and ``HOT_ROWS``) by broadcast,
    others by a shuffle join.

    A rule fits its host and all subdomains, where the path starts with the rule's; an empty host fits none, and its rows
    are answered where they are. Where none fits, the verdict is ``default``: a filter lets through what no rule names. A
    null or malformed url has an empty host and path. Repeated rows and rules, ids that repeat or are null, and empty
    tables give one row per page row.
    """
    host, path = host_and_path(F.col(f"`{url_col}`"))
    judged = pages.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"))
    clean = rules.select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), (F.col("verdict") == "block").alias("blocks"))
    clean = clean.where("rule_host is not null and rule_host <> '' and rule_path is not null and blocks is not null").distinct()
    shape = clean.agg(F.count("*"), F.collect_set(F.length("rule_path")), F.collect_set(_labels(F.col("rule_host")))).first()
    numbers = lambda of: F.array(*[F.lit(n) for n in sorted(of)]).cast("array<int>")
    keyed_rules = clean.withColumn("full", _digest(F.col("rule_host"), F.col("rule_path"))).withColumn("short", F.substring("full", 1, prefix_chars))
    keyed_rules = F.broadcast(keyed_rules) if shape[0] <= broadcast_rules else keyed_rules

    named = judged.where("host <> ''")
    urls = named.groupBy("host", "path").agg(F.count("*").alias("rows")).withColumn("labels", _labels(F.col("host")))
    suffix = lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n)
    suffixed = urls.select("host", "path", "rows", F.explode_outer(F.transform(F.filter(numbers(shape[2]), lambda n: n <= F.col("labels")), suffix)).alias("suffix"))
    starts = F.transform(F.filter(numbers(shape[1]), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = suffixed.select("host", "path", "rows", "suffix", F.explode_outer(starts).alias("start")).withColumn("digest", _digest(F.col("suffix"), F.col("start")))
    met = (F.substring("digest", 1, prefix_chars) == F.col("short")) & (F.col("digest") == F.col("full"))
    rank = F.struct((F.length("rule_host") + F.length("rule_path")).alias("long"), F.length("rule_host").alias("deep"), "blocks", F.concat("rule_host", "rule_path").alias("rule"))
    hits = expressions.join(keyed_rules, met, "left").select("host", "path", "rows", F.when(F.col("full").isNotNull(), rank).alias("rank"))
    best = staged(hits.groupBy("host", "path", "rows").agg(F.max("rank").alias("best")), "url-rules")
    hot = F.col("rows") > max(HOT_ROWS, int((best.agg(F.sum("rows")).first()[0] or 0) * HOT_SHARE))
    # at most 1 / HOT_SHARE urls can be hot
    marked = named.join(F.broadcast(best.where(hot)), ["host", "path"], "left")
    others = marked.where("rows is null").select("page_id", "host", "path").join(best.where(~hot), ["host", "path"])
    bare = judged.where("host = ''").withColumn("best", F.lit(None).cast(best.schema["best"].dataType))
    kept = ["page_id", "host", "path", "best"]
    answered = bare.select(kept).unionByName(marked.where("rows is not null").select(kept)).unionByName(others.select(kept))
    return answered.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.when(F.col("best").isNull(), F.lit(default)).when(F.col("best.blocks"), F.lit("block")).otherwise(F.lit("allow")).alias("verdict"),
    )


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.translate(host, ".", "")) + 1
