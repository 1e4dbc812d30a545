"""URL allow and block rules by a sort-merge range join over reversed-host keys.

A host's canonical key is its labels in reverse, each followed by a dot (``www.example.com`` -> ``com.example.www.``), so
a rule for a host and all its subdomains is the key interval from ``com.example.`` up to, not including, ``com.example/``.
Rule intervals are nested or apart. URLs and the intervals' ends are sorted together by key; sweeping over them, the
last end seen carries the stack of the intervals that are open there. Range partitions let the sweep run everywhere at
once: each begins with the stack that is open at its first key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import named, stored, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CLOSE, OPEN, URL, CARRY = 1, 2, 3, 0

#: The rules of op8: (host, path, verdict).
RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block")
]


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _open_at(keys: DataFrame, hosts: DataFrame) -> DataFrame:
    """(key, stack): the rules of all hosts whose interval holds the key, outermost first."""
    parts = F.split("key", r"\.")
    above = keys.select(
        "key",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
                lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "."), F.lit("."))
            )
        ).alias("outer")
    )
    held = above.join(hosts.select(F.col("key").alias("outer"), "own"), "outer").groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct(F.length("outer").alias("n"), "own"))).alias("found")
    )
    return held.select("key", F.flatten(F.transform("found", lambda x: x["own"])).alias("stack"))


def judge_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", page_id: str = "page_id", default: str = "allow"
) -> DataFrame:
    """Adds host, path, rule and verdict to page_id.

    rules: host, path, verdict. A rule fits its host and all subdomains where the url's path starts with the rule's; the
    longest (host and path together, then the longer host, then the greater verdict: block before allow) wins. Where none fits, rule is null
    and verdict is ``default``. A null url, or one without ``://``, has an empty host and path. Rules with a null host or
    path never fit; repeated rules count once; repeated pages are judged each; other columns are ignored.
    """
    rules = rules.select(
        F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict"
    ).dropna(subset=["host", "path"]).distinct()
    rule = F.struct(
        F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("host_size"),
        F.concat("host", "path").alias("rule"), "path", "verdict"
    )
    hosts = rules.groupBy(key_of(F.col("host")).alias("key")).agg(F.sort_array(F.collect_list(rule)).alias("own"))
    stacks = hosts.join(_open_at(hosts.select("key"), hosts), "key")
    kind = pages.select(named(page_id)).schema[0].dataType
    none = [
        F.lit(None).cast(kind).alias("page_id"), F.lit(None).cast("string").alias("host"),
        F.lit(None).cast("string").alias("path")
    ]
    opens = stacks.select("key", F.lit(OPEN).alias("kind"), *none, "stack")
    # Closing a host's interval leaves what stood below it: the stack without the host's own rules.
    closes = stacks.select(
        F.expr("concat(substr(key, 1, length(key) - 1), '/')").alias("key"), F.lit(CLOSE).alias("kind"), *none,
        F.expr("slice(stack, 1, size(stack) - size(own))").alias("stack")
    )
    urls = pages.select(
        named(page_id).alias("page_id"), host_of(named(url)).alias("host"), path_of(named(url)).alias("path")
    )
    urls = urls.select(
        key_of(F.col("host")).alias("key"), F.lit(URL).alias("kind"), "page_id", "host", "path",
        F.lit(None).cast(opens.schema["stack"].dataType).alias("stack")
    )
    spark = pages.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "kind", "path", "page_id"]  # so that one host, or one path, is dealt over many partitions
    events = stored(
        urls.unionByName(opens).unionByName(closes).repartitionByRange(parts, *order).withColumn(
            "part", F.spark_partition_id()
        )
    )
    first = events.groupBy("part").agg(F.min("key").alias("key"))
    carry = first.join(_open_at(first.select("key").distinct(), hosts), "key", "left").select(
        "key", F.lit(CARRY).alias("kind"), *none,
        F.coalesce("stack", F.array().cast(opens.schema["stack"].dataType)).alias("stack"), "part"
    )
    sweep = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = events.unionByName(carry).withColumn(
        "stack", F.last("stack", ignorenulls=True).over(sweep)
    ).filter(F.col("kind") == URL)
    best = F.array_max(F.filter("stack", lambda r: F.startswith(F.col("path"), r["path"])))
    return swept.withColumn("best", best).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges every url of ``pages`` by the five rules."""
    return judge_urls(
        table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string")
    )


SQL = """
WITH urls AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fit AS (
  SELECT page_id, r.host || r.path AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r.host || r.path) DESC) AS k
  FROM urls u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM urls u LEFT JOIN fit f ON u.page_id = f.page_id AND f.k = 1
"""
