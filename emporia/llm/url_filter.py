"""URL filters: prefix rules on reversed hosts, met with the URLs in one sorted sweep."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emporia.llm.common import fresh, keeps_own_columns
from emporia.sources.store import work_table

ADDED = ("host", "path", "rule", "verdict")
RULES_SCHEMA = "host string, path string, verdict string"
DEFAULT = "allow"
END = "\x01"  # stands between host and path in a key; sorts before any character of a host


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add host and path of a URL; both empty without `://`."""
    at = F.coalesce(F.instr(F.col(url), "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(F.col(url)))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return pages.withColumns({"host": ascii_lower(host), "path": F.regexp_extract(tail, r"^[^?#]*", 0)})


def reversed_labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def nested(rules: DataFrame) -> DataFrame:
    """(key, chain): every rule key with the rules whose interval it lies in, itself included.

    A prefix key covers the interval of all keys that begin with it, and such intervals nest or
    are apart. Of rules with the same key `block` wins.
    """
    key = F.concat(F.array_join(reversed_labels(ascii_lower(F.col("host"))), "."), F.lit(END), F.col("path"))
    single = (
        rules.dropna(subset=["host", "path", "verdict"])
        .select(key.alias("key"), F.concat("host", "path").alias("rule"), "verdict")
        .groupBy("key")
        .agg(F.max(F.struct("verdict", "rule")).alias("top"))
        .select("key", "top.rule", "top.verdict")
    )
    outer = single.select(F.col("key").alias("_prefix"), F.struct("key", "rule", "verdict").alias("outer"))
    # Enclosing rules have the same host and a beginning of the path: each beginning is looked up, so that
    # the work grows with the length of the rules and not with the square of a host's number of them.
    least = F.length(F.substring_index("key", END, 1)) + 1
    beginnings = F.transform(F.sequence(least, F.length("key")), lambda n: F.substring(F.col("key"), F.lit(1), n))
    return (
        single.select("key", F.explode(beginnings).alias("_prefix"))
        .join(outer, "_prefix")
        .groupBy("key")
        .agg(F.array_sort(F.collect_list("outer")).alias("chain"))
    )


def sweep(points: DataFrame, rules: DataFrame, partitions: int | None = None) -> DataFrame:
    """Add to `points` (key) the `chain` of the last rule that starts at or before the key.

    Rules and points are sorted together by range partitions. Within one, the last rule seen is
    carried along; a partition starts with the last rule of those before it. As rule intervals nest, all
    rules that are open at a point are in the chain of the last one that was started, so the chain is
    the stack of the sweep. Points of one very common host spread over ranges by their paths.
    """
    marked = points.select("*", F.lit(1).alias("_late"), F.lit(None).cast(rules.schema["chain"].dataType).alias("chain"))
    starts = rules.select("key", F.lit(0).alias("_late"), "chain")
    both = marked.unionByName(starts, allowMissingColumns=True)
    order = ["key", "_late"]
    ranged = both.repartitionByRange(*order) if partitions is None else both.repartitionByRange(partitions, *order)
    parts = work_table(ranged.withColumn("_part", F.spark_partition_id()))
    last = parts.where("_late = 0").groupBy("_part").agg(F.max_by("chain", "key").alias("_last"))
    ids = parts.select("_part").distinct().join(last, "_part", "left")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    carried = ids.select("_part", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    so_far = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        parts.join(carried, "_part")
        .withColumn("chain", F.coalesce(F.last("chain", ignorenulls=True).over(so_far), "_carried"))
        .where("_late = 1")
        .drop("_late", "_part", "_carried")
    )


@keeps_own_columns
def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, url: str = "url") -> DataFrame:
    """Rows of `pages` with host, path, rule and verdict.

    A rule (host, path, verdict) fits its host and all subdomains if the URL's path starts with the
    rule's; the longest fitting rule (host and path) decides, else `default`. Each distinct (host, path)
    is judged once: with one key for each of its last labels, up to the most labels of a rule host.

    A null URL or one without `://` has empty host and path and gets the default. Rules with a null
    in them are void. Repeated pages are judged alike; columns named like the added ones are replaced; an
    empty table, of pages or rules, is no fault.
    """
    rows = with_parts(fresh(pages, *ADDED), url)
    depth = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 1
    labels = reversed_labels(F.col("host"))
    some = F.array_join(F.slice(F.col("_labels"), F.lit(1), F.col("_n")), ".")
    points = (
        rows.select("host", "path")
        .distinct()
        .withColumn("_labels", F.slice(labels, 1, depth))
        .withColumn("_n", F.explode(F.sequence(F.lit(1), F.size("_labels"))))
        .select("host", "path", F.concat(some, F.lit(END), "path").alias("key"))
    )
    fitting = F.filter("chain", lambda r: F.startswith(F.col("key"), r["key"]))
    longest = F.array_max(
        F.transform(fitting, lambda r: F.struct(F.length(r["rule"]).alias("n"), r["verdict"].alias("v"), r["rule"].alias("r")))
    )
    found = (
        sweep(points, nested(rules))
        .select("host", "path", longest.alias("_best"))
        .where("_best IS NOT NULL")
        .groupBy(F.col("host").alias("_host"), F.col("path").alias("_path"))
        .agg(F.max("_best").alias("_best"))
    )
    same = F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path"))
    return (
        rows.join(found, same, "left")
        .withColumns({"rule": F.col("_best.r"), "verdict": F.coalesce("_best.v", F.lit(default))})
        .drop("_best", "_host", "_path")
    )
