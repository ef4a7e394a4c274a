"""URL filters as a sort-merge range join over reversed-host keys.

``de.example.net`` becomes the key ``net,example,de,``: the hosts below a
rule's host are exactly the keys that start with the rule's key, an interval
of the sorted order.  Such intervals nest or are disjoint, so the rules that
hold at a point are the ones on the stack of the last rule the sweep has
opened.  Every rule row carries that stack (itself and the rules around it);
the sweep hands the last stack to each point, which drops the rules that have
closed.  The sweep runs twice: over hosts, then per matched rule host over
paths, where prefixes nest the same way.  Built-in functions only.

Defined cases: a null url or one without ``://`` has empty host and path and
fits no rule; a rule list may repeat a (host, path) -- block wins; an empty
rule list or table gives the default verdict or no rows.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RULES_SCHEMA = "host string, path string, verdict string"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Reversed labels, each closed by a comma, so that ``net,`` is no prefix of ``network,``."""
    return F.when(host == "", F.lit("")).otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(",")))


def rules_frame(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Rules from ``(verdict, "host/path")`` pairs; the path starts at the slash."""
    rows = [(text.partition("/")[0].lower(), "/" + text.partition("/")[2], verdict) for verdict, text in rules]
    return spark.createDataFrame(rows, RULES_SCHEMA)


def _sweep(points: DataFrame, opened: DataFrame, key: str, within: list[str], lanes: int) -> DataFrame:
    """``points`` with ``stack``: the array of the last row of ``opened`` (columns
    ``within``, ``key``, ``stack``) at or before their ``key``.

    Points are dealt by ``within`` and a lane, so a key of any frequency is
    shared by ``lanes`` tasks; each lane sweeps its sorted points once beside
    all opened rows of its group (one copy of the rules per lane).
    """
    lane = F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane")
    events = opened.select(*within, key, "stack", lane)
    marked = points.withColumn("stack", F.lit(None).cast(events.schema["stack"].dataType))
    order = Window.partitionBy(*within, "lane").orderBy(key, F.col("point").isNotNull())
    return (marked.unionByName(events, allowMissingColumns=True)
            .withColumn("stack", F.last("stack", ignorenulls=True).over(
                order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
            .where(F.col("point").isNotNull()))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
          default: str = "allow") -> DataFrame:
    """``(page_id, host, path, rule, verdict)``, one row per page.

    ``rules``: (host, path, verdict).  A rule fits its host and all subdomains
    where the url's path starts with the rule's; the longest ``host + path``
    wins.  ``rule`` is that text, null without a fit; then ``verdict`` is
    ``default``.  Pages with the same url are judged once per row.
    """
    lanes = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rules = (rules.where(F.col("host") != "").groupBy("host", "path")
             .agg(F.max("verdict").alias("verdict"))           # "block" > "allow"
             .withColumn("key", host_key(F.col("host"))))
    hosts = rules.select("host", "key").distinct()
    # the rule hosts around each rule host: its own suffixes that are rule hosts
    labels = F.split("host", r"\.")
    suffixes = hosts.select("key", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("suffix"))
    open_hosts = (suffixes.join(hosts.select(F.col("host").alias("suffix"), F.col("key").alias("outer")), "suffix")
                  .groupBy("key").agg(F.collect_set("outer").alias("stack"))
                  .withColumn("top", F.substring_index("key", ",", 1)))
    # the rules around each rule of one host: its path prefixes that are rules
    prefixes = rules.select("key", "path", F.explode(F.transform(
        F.sequence(F.lit(0), F.length("path")), lambda i: F.col("path").substr(F.lit(1), i))).alias("prefix"))
    outer = rules.select("key", F.col("path").alias("prefix"), F.struct(
        F.length(F.concat("host", "path")).alias("length"), "path",
        F.concat("host", "path").alias("rule"), "verdict").alias("entry"))
    open_paths = (prefixes.join(outer, ["key", "prefix"])
                  .groupBy("key", "path").agg(F.collect_list("entry").alias("stack")))

    url = F.col(url_col)
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("page_id"),
                        url_host(url).alias("host"), url_path(url).alias("path"))
    rows = (rows.withColumn("point", F.struct("row", "page_id", "host", "path"))
            .withColumn("key", host_key(F.col("host")))
            .withColumn("top", F.substring_index("key", ",", 1))
            .withColumn("lane", F.pmod(F.col("row"), F.lit(lanes)).cast("int")))
    at_host = _sweep(rows.select("point", "key", "top", "lane"), open_hosts, "key", ["top"], lanes)
    still_open = F.filter("stack", lambda outer_key: F.col("key").startswith(outer_key))
    # one row per open host (at most the labels of a host); a page below none keeps a null key
    reached = (at_host.select("point", "lane", F.explode_outer(still_open).alias("key"))
               .withColumn("path", F.col("point.path")))
    at_path = _sweep(reached, open_paths, "path", ["key"], lanes)
    fits = F.filter("stack", lambda rule: F.col("path").startswith(rule["path"]))
    return (at_path.select("point", F.array_max(fits).alias("best"))
            .groupBy("point").agg(F.max("best").alias("best"))
            .select("point.page_id", "point.host", "point.path", "best.rule",
                    F.coalesce("best.verdict", F.lit(default)).alias("verdict")))
