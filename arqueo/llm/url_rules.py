"""URL rules by a sort-merge range join.

A rule (host, path, verdict) fits the URLs of its host and all subdomains whose path starts with the rule's path. The labels of a
host, reversed and each closed by a dot, make a canonical key: the hosts under a rule's host are the interval of keys that start
with the rule's key, and the paths under a rule's path are such an interval among the paths. Intervals of prefixes nest or are apart.

`sweep` joins points to the intervals around them. Points, openings and closings of intervals are sorted together in ranges; an
interval that is open across the border of a range is opened again there. Inside a range the number of open intervals is a
running sum, and the stack of open intervals is what was last opened at each height up to that number. The first sweep runs over
distinct hosts and finds all rule hosts around each, the second over the distinct paths under these and finds the longest rule.
Rows of the table meet only their own URL's verdict; a host or a URL that owns a third of the rows is one point.

Of the rules that fit the longest wins: most characters of host and path together, then of the host. Of rules with the same host
and path the verdict that sorts last counts (`block` over `allow`).

Defined cases: a null URL, or one without `://`, has an empty host and path; A-Z of hosts are lower-cased, in rules too; a null host
or path of a rule counts as empty, an empty host is around every host; URLs that no rule fits get `otherwise`; repeated rows
are judged each; empty tables of URLs or rules are fine; other columns are kept by `judge`, whatever their names.
"""

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arqueo.llm.common import fresh, landed
from arqueo.operators.joins import skew_join

PLACE = r"(?s)^.*?://([^/?#]*)([^?#]*)"
AGAIN, OPEN, POINT, CLOSE = range(4)  # events of one place come in this order


def lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return lower(F.coalesce(F.regexp_extract(url, PLACE, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PLACE, 2), F.lit(""))


def host_key(host: Column) -> Column:
    """Reversed labels, each with a dot after it; empty for an empty host."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def sweep(points: DataFrame, intervals: DataFrame, innermost: bool) -> DataFrame:
    """`points` (space, key, id) and `intervals` (space, key), strings and distinct rows -> id, space, key of the point and `around`,
    the key of an interval of the same space with which the point's key starts. One row per interval around, or the longest
    one if `innermost`; points without any are left out."""
    at = F.col("key").cast("binary")
    opened = intervals.select("space", "key", F.lit(None).cast("string").alias("id"))
    events = (
        points.select("space", "key", "id", at.alias("at"), F.lit(POINT).alias("kind"))
        .unionByName(opened.select("*", at.alias("at"), F.lit(OPEN).alias("kind")))
        # No UTF-8 text holds the byte FF, so this place is behind all keys that start with the interval's.
        .unionByName(opened.select("*", F.concat(at, F.lit(b"\xff")).alias("at"), F.lit(CLOSE).alias("kind")))
    )
    partitions = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = landed(events.repartitionByRange(partitions, "space", "at", "kind", "id").withColumn("range", F.spark_partition_id()))
    # An interval reaches over few borders or many, but no border has more open intervals than they nest.
    reach = dealt.where(F.col("kind") != POINT).groupBy("space", "key").agg(F.min("range").alias("first"), F.max("range").alias("last"))
    across = reach.where("last > first").select(
        "space", "key", F.lit(None).cast("string").alias("id"), F.col("key").cast("binary").alias("at"), F.lit(AGAIN).alias("kind"),
        F.explode(F.sequence(F.col("first") + 1, F.col("last"))).alias("range"))
    order = [(F.col("kind") != AGAIN), "space", "at", "kind", "id"]
    change = F.when(F.col("kind") == POINT, 0).when(F.col("kind") == CLOSE, -1).otherwise(1)
    running = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    stacked = dealt.unionByName(across).withColumn("open", F.sum(change).over(running))
    heights = F.when(F.col("kind") != POINT, F.array("open"))
    heights = heights.otherwise(F.array("open") if innermost else F.sequence(F.lit(1).cast("long"), F.col("open")))
    levels = stacked.where((F.col("kind") != CLOSE) & (F.col("open") > 0)).withColumn("height", F.explode(heights))
    before = Window.partitionBy("range", "height").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    around = F.last(F.when(F.col("kind") != POINT, F.col("key")), ignorenulls=True).over(before)
    return levels.withColumn("around", around).where(F.col("kind") == POINT).select("id", "space", "key", "around")


def tidy(rules: DataFrame) -> DataFrame:
    """Distinct rules: host, path, verdict, host_key."""
    host = lower(F.coalesce(F.col("host").cast("string"), F.lit("")))
    plain = rules.select(host.alias("host"), F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), "verdict")
    return plain.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("host_key", host_key(F.col("host")))


def judge(pages: DataFrame, rules: DataFrame, url_column: str = "url", otherwise: str = "allow") -> DataFrame:
    """`pages` with `host`, `path`, `rule` (host and path of the longest rule that fits, or null) and `verdict`. Columns of
    these names that `pages` has already are replaced."""
    rules = landed(tidy(rules))
    names = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    url = F.col(f"`{url_column}`").cast("string")
    rows = pages.select(*(F.col(f"`{c}`") for c in names), host_of(url).alias("host"), path_of(url).alias("path"))
    places = landed(rows.select("host", "path").distinct())
    hosts = places.select("host").distinct().select(F.lit("").alias("space"), host_key(F.col("host")).alias("key"), F.col("host").alias("id"))
    rule_hosts = rules.select(F.lit("").alias("space"), F.col("host_key").alias("key")).distinct()
    under = sweep(hosts, rule_hosts, innermost=False).select(F.col("id").alias("host"), F.col("around").alias("space"))
    paths = skew_join(places, under, ["host"]).select("space", F.col("path").alias("key"), F.col("host").alias("id"))
    rule_paths = rules.select(F.col("host_key").alias("space"), F.col("path").alias("key"))
    fitting = sweep(paths, rule_paths, innermost=True).select(F.col("id").alias("host"), F.col("key").alias("path"), "space", "around")
    length = F.length("rule_host") + F.length("rule_path")
    named = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict", F.col("host_key").alias("space"), F.col("path").alias("around"))
    found = skew_join(fitting, named, ["space", "around"])
    best = found.groupBy("host", "path").agg(F.max(F.struct(
        length.alias("length"), F.length("rule_host").alias("host_length"), F.concat("rule_host", "rule_path").alias("rule"), "verdict")).alias("best"))
    top = fresh(pages, "best")
    judged = skew_join(rows, best.withColumnRenamed("best", top), ["host", "path"], "left")
    return judged.select(*(F.col(f"`{c}`") for c in names), "host", "path", F.col(f"{top}.rule").alias("rule"),
                         F.coalesce(F.col(f"{top}.verdict"), F.lit(otherwise)).alias("verdict"))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A short list of rules (host, path, verdict) as a table."""
    rows = [F.struct(*(F.lit(value).cast("string").alias(name) for name, value in zip(("host", "path", "verdict"), rule))) for rule in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))
