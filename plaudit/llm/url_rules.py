"""URL rules by a sorted sweep over reversed hosts. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plaudit.scratch import new_path, store

# The rules of the query, as (action, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))

# A URL that no rule fits.
DEFAULT = "allow"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without `://` and for null."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def reversed_host(host: Column) -> Column:
    """`www.example.com` as `com.example.www.`: a host and its subdomains share a prefix."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def rule_table(spark, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame([(i, *rule) for i, rule in enumerate(rules)],
                                 "rule_id INT, action STRING, rule_host STRING, rule_path STRING")


def _after(prefix: Column) -> Column:
    """The smallest text above every text that starts with ``prefix``, which ends in a full stop."""
    return F.concat(F.regexp_replace(prefix, r"\.$", ""), F.lit("/"))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """``pages`` with host, path, rule and verdict: the longest rule that fits each URL.

    Hosts are turned around, so that a rule's host and all its subdomains are one interval of keys
    and intervals nest. Interval bounds and pages are range-partitioned and sorted by key. The
    sweep carries the stack of rules that are open at a key: each bound holds the whole stack from
    there on, so the last bound before a page tells it. The stack is an array of the rules nested
    around one host, as deep as a host has labels and as wide as rules share one host; of these
    the longest whose path starts the URL's path is the rule.

    The range key goes on with the page's own hash, so a host with any share of the pages is dealt
    over many tasks. Each range takes its first stack from the last bound before it: one row per
    range is all that meets in one task.

    Without `://` a URL has neither host nor path and no rule fits. Rules need a host; an empty
    rule table gives every page the default. Columns of the result's names are replaced.
    """
    path = new_path(pages.sparkSession, "urls")
    host, rest = host_and_path(F.col(url))
    named = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    keyed = pages.select(*named).withColumns({"host": host, "path": rest})
    bounds = store(_bounds(rules), f"{path}/bounds")
    rows = keyed.select(F.struct(*[F.col(c) for c in [*named, "host", "path"]]).alias("page"),
                        reversed_host(F.col("host")).alias("key"), F.lit(1).alias("kind"),
                        F.xxhash64(F.col(url), F.rand(7)).alias("salt"))
    kinds = {f.name: f.dataType for f in rows.schema}
    marks = bounds.select(F.lit(None).cast(kinds["page"]).alias("page"), "key", F.lit(0).alias("kind"),
                          F.lit(0).cast("long").alias("salt"), "stack")
    swept = rows.withColumn("stack", F.lit(None).cast(bounds.schema["stack"].dataType)).unionByName(marks)
    swept = swept.repartitionByRange("key", "kind", "salt").withColumn("range", F.spark_partition_id())
    swept = store(swept, f"{path}/ranges")
    order = ["key", "kind", "salt"]
    last = swept.where("kind = 0").groupBy("range").agg(F.max_by("stack", "key").alias("stack"))
    ranges = swept.select("range").distinct().join(last, "range", "left")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = store(ranges.select("range", F.last("stack", True).over(before).alias("carried")), f"{path}/carried")
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    open_rules = F.coalesce("stack", "carried", F.array().cast(bounds.schema["stack"].dataType))
    found = (swept.withColumn("stack", F.last("stack", True).over(inside)).where("kind = 1")
             .join(F.broadcast(carried), "range").withColumn("stack", open_rules))
    fits = F.filter("stack", lambda r: F.startswith(F.col("page.path"), r["rule_path"]))
    chosen = F.get(F.reverse(F.array_sort(F.transform(fits, lambda r: F.struct(
        F.char_length(r["rule_host"]).alias("host_chars"), F.char_length(r["rule_path"]).alias("path_chars"),
        (-r["rule_id"]).alias("first"), F.concat(r["rule_host"], r["rule_path"]).alias("rule"),
        r["action"].alias("action"))))), F.lit(0))
    found = found.withColumn("chosen", chosen)
    return found.select(*[F.col("page")[c].alias(c) for c in [*named, "host", "path"]],
                        F.col("chosen.rule").alias("rule"),
                        F.coalesce("chosen.action", F.lit(default)).alias("verdict"))


def _bounds(rules: DataFrame) -> DataFrame:
    """(key, stack): from this key on, the rules whose interval is open.

    Opening a host pushes its rules on the stack of the host around it; closing it goes back to
    that stack. The stack of a host holds the rules of the host and of its parent domains, which
    are looked up by an equi-join on each suffix of the host.
    """
    rule = F.struct("rule_id", "action", "rule_host", "rule_path")
    own = rules.groupBy("rule_host").agg(F.array_sort(F.collect_list(rule)).alias("rules"))
    labels = F.split("rule_host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(
        F.slice(labels, i, F.size(labels) - i + 1), "."))
    around = own.select(F.col("rule_host").alias("host"), F.posexplode(suffixes).alias("up", "rule_host"))
    stacks = around.join(own, "rule_host").groupBy("host").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("up", "rules"))), lambda x: x["rules"])).alias("stack"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("up") > 0, F.struct("up", "rules")))),
                              lambda x: x["rules"])).alias("outer"))
    key = reversed_host(F.col("host"))
    opened = stacks.select(key.alias("key"), F.lit(1).alias("opens"), "stack")
    closed = stacks.select(_after(key).alias("key"), F.lit(0).alias("opens"), F.col("outer").alias("stack"))
    # Where one interval ends another may begin: the bound that opens decides.
    return opened.union(closed).groupBy("key").agg(F.max_by("stack", "opens").alias("stack"))
