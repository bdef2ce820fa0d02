"""URL filters by a sort-merge range join.

A host is written with its labels reversed and each closed by a dot (`www.example.org` becomes
`org.example.www.`). A rule for a host and its subdomains then covers the interval of keys from
`org.example.` up to `org.example/`, since `/` follows `.` in byte order, and intervals of rules nest or are
apart. The boundaries of all intervals are sorted together with the urls' keys; at each boundary the stack
of rules active from there on is known (the rule's own host and its enclosing ones), so a sweep that carries
the last boundary's stack gives every url its active rules. Of those whose path is a prefix of the url's
path, the longest wins.

Sweeps run in lanes, as many as shuffle partitions or more: urls are dealt by a hash of all the row's columns,
whatever their host, so a host with a third of all urls is no hot spot. Each lane gets all boundaries (two for
each rule's host), so rules are copied lanes times: meant for lists of rules far shorter than a lane.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm._common import quoted


def url_host(url: Column) -> Column:
    """What stands after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _boundaries(rules: DataFrame) -> DataFrame:
    """(at, stack): from key `at` on, these rules are active, until the next boundary.

    The stack at the start of a host's interval holds the rules of that host and of the hosts it lies in,
    found by joining each host's suffixes with the hosts of rules; at its end the stack is that of the hosts
    it lies in alone.
    """
    rule = F.struct("rule_host", "rule_path", "action").alias("rule")
    by_host = rules.groupBy("rule_host").agg(F.collect_set(rule).alias("own"))
    suffixes = by_host.select("rule_host", F.explode(F.expr("sequence(1, size(split(rule_host, '[.]', -1)))")).alias("k"))
    suffixes = suffixes.select("rule_host", F.expr("array_join(slice(split(rule_host, '[.]', -1), -k, k), '.')").alias("suffix"))
    stacks = (
        suffixes.join(by_host.select(F.col("rule_host").alias("suffix"), "own"), "suffix")
        .groupBy("rule_host")
        .agg(
            F.flatten(F.collect_list("own")).alias("whole"),
            F.flatten(F.collect_list(F.when(F.col("suffix") != F.col("rule_host"), F.col("own")))).alias("outer"),
        )
    )
    key = reversed_key(F.col("rule_host"))
    start = F.struct(key.alias("at"), F.col("whole").alias("stack"))
    end = F.struct(F.concat(F.expr("substring(k, 1, length(k) - 1)"), F.lit("/")).alias("at"), F.col("outer").alias("stack"))
    return stacks.withColumn("k", key).select(F.explode(F.array(start, end)).alias("b")).select("b.*")


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    url: str = "url",
    default: str = "allow",
    unusable: str = "block",
    rows_per_lane: int = 500_000,
) -> DataFrame:
    """pages with host, path, rule and verdict.

    rules: rule_host, rule_path, action. A rule fits its host and all subdomains if the path starts with the
    rule's; the longest host and path together win, and of equal lengths the longer host, then `block`. Where none fits, rule is null and the verdict is `default`, or `unusable` for a url without a
    host (null, empty, no `://`). Repeated rows are judged each; input columns with the names of the added
    ones are replaced. An empty table gives no rows; without rules every url gets the defaults. Hosts are
    compared as they stand, so a port belongs to the host.
    """
    added = ("host", "path", "rule", "verdict")
    lanes = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pages.count() // rows_per_lane))
    u = quoted(pages, url).cast("string")
    rows = pages.select(F.struct(*[quoted(pages, c).alias(c) for c in pages.columns]).alias("row"), url_host(u).alias("host"), url_path(u).alias("path"), u.alias("u"))
    lane = F.pmod(F.xxhash64("row"), F.lit(lanes)).alias("lane")
    keyed = rows.select(lane, F.when(F.col("host") == "", F.lit("")).otherwise(reversed_key(F.col("host"))).alias("at"), "row", "host", "path")
    bounds = _boundaries(rules.select("rule_host", "rule_path", "action"))
    bounds = bounds.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).select(F.col("lane").cast("long"), "at", "stack")
    swept = keyed.withColumn("stack", F.lit(None).cast(bounds.schema["stack"].dataType)).unionByName(bounds, allowMissingColumns=True)
    # A boundary comes before a url of the same key: of equal keys, rows without a url are first.
    sweep = Window.partitionBy("lane").orderBy("at", F.col("row").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    active = swept.withColumn("active", F.last("stack", ignorenulls=True).over(sweep)).where(F.col("row").isNotNull())
    fit = F.expr(
        "array_max(transform(filter(active, r -> startswith(path, r.rule_path)), r -> struct("
        "char_length(r.rule_host) + char_length(r.rule_path) as size, char_length(r.rule_host) as host_size,"
        " if(r.action = 'block', 1, 0) as stricter, r.rule_host || r.rule_path as rule, r.action as action)))"
    )
    judged = active.withColumn("best", F.when(F.col("host") != "", fit))
    other = F.when(F.col("host") == "", F.lit(unusable)).otherwise(F.lit(default))
    return judged.select(
        *[F.col("row")[c].alias(c) for c in pages.columns if c not in added],
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.action"), other).alias("verdict"),
    )
