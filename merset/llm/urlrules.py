"""URL rules by sort-merge range joins, with DataFrame functions only.

A host is written with its labels reversed and a dot after each
(``www.example.com`` becomes ``com.example.www.``). A rule's host and all its
subdomains are then one interval of keys, ``[com.example., com.example/)``,
and intervals of different hosts are nested or disjoint. Paths behind such a
key nest in the same way: all that begin with ``com.example.//en/`` are one
interval. So a url is judged by two sweeps: the first, over hosts, gives it the
rule hosts that are open at its own (at most as many as it has labels); the
second, over host and path, gives for each of these the longest rule open there.

In a sweep, rows and interval bounds are sorted together by ranges of the key.
Each bound holds what is open from it on, so a row needs the last bound before
it, and a range needs, besides its own bounds, only the last one of the ranges
before. Bounds are never copied to several ranges, and ranges split rows of
equal keys by their ids, so one host or path with a third of all urls is spread
like any other. Nothing is broadcast but one state for each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merset.session import cut, partitions

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Host and path after the first ``://``.
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def host_key(host: Column, end: str = ".") -> Column:
    """``www.example.com`` as the bytes of ``com.example.www.``"""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(end)).cast("binary")


def path_key(host: Column, path: Column) -> Column:
    """Hosts hold no slash, so the first one ends the host's part of the key."""
    return F.concat(host_key(host), F.lit("/").cast("binary"), path.cast("binary"))


def clean_rules(rules: DataFrame) -> DataFrame:
    """host, path, action, once each; rules with a null host or path, or with a host that no url has, are left out."""
    return (
        rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "action")
        .where(~F.col("host").rlike("[/?#]") & F.col("path").isNotNull())
        .groupBy("host", "path")
        .agg(F.max(F.coalesce(F.col("action") == "block", F.lit(False))).alias("blocks"))
        .select("host", "path", F.when(F.col("blocks"), "block").otherwise("allow").alias("action"))
    )


def host_bounds(clean: DataFrame) -> DataFrame:
    """(key, open): where each rule host's interval opens and closes, and the rule hosts open from there on."""
    hosts = clean.select("host").distinct()
    labels = F.split("host", r"\.")
    up = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parents = hosts.select("host", F.explode(up).alias("at"))
    chains = parents.join(hosts.select(F.col("host").alias("at")), "at").groupBy("host").agg(F.collect_set("at").alias("open"))
    opens = chains.select(host_key(F.col("host")).alias("key"), "open")
    closes = chains.select(host_key(F.col("host"), "/").alias("key"), F.array_remove("open", F.col("host")).alias("open"))
    return opens.unionByName(closes)


def path_bounds(clean: DataFrame) -> DataFrame:
    """(key, open): where each rule's interval of host and path opens and closes, and the longest rule open from there on.

    What is open behind a rule is the longest other rule of its host whose path
    its own begins with, found by an equi-join on its beginnings of the lengths
    that rules of the host have.
    """
    rule = F.struct((F.length("host") + F.length("path")).alias("len"), F.length("host").alias("host_len"), "host", "path", "action").alias("rule")
    whole = clean.select("host", "path", rule)
    lengths = clean.groupBy("host").agg(F.collect_set(F.length("path")).alias("lengths"))
    shorter = F.filter("lengths", lambda n: n < F.length("path"))
    outer = (
        clean.join(lengths, "host").select("host", "path", F.explode(shorter).alias("n"))
        .select("host", F.col("path").alias("inner"), F.substring("path", F.lit(1), F.col("n")).alias("path"))
        .join(whole, ["host", "path"]).groupBy("host", F.col("inner").alias("path")).agg(F.max("rule").alias("outer"))
    )
    key = path_key(F.col("host"), F.col("path"))
    opens = whole.select(key.alias("key"), F.array("rule").alias("open"))
    closes = whole.join(outer, ["host", "path"], "left").select(
        F.concat(key, F.unhex(F.lit("FF"))).alias("key"),  # a byte above all of UTF-8
        F.array_compact(F.array("outer")).alias("open"),
    )
    return opens.unionByName(closes)


def sweep(rows: DataFrame, bounds: DataFrame, ranges: int) -> DataFrame:
    """``rows`` (key, id and others), each with ``open`` of the last bound at or before its key; null where none is."""
    spark = rows.sparkSession
    both = rows.withColumn("bound", F.lit(0)).unionByName(bounds.withColumn("bound", F.lit(-1)), allowMissingColumns=True)
    dealt = both.repartitionByRange(ranges, "key", "bound", "id").withColumn("range", F.spark_partition_id())
    written = cut(dealt, "url-sweep")
    last = written.where("bound < 0").groupBy("range").agg(F.max_by("open", "key").alias("last"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        spark.range(ranges).select(F.col("id").cast("int").alias("range")).join(last, "range", "left")
        .select("range", F.last("last", True).over(before).alias("carried"))
    )
    within = Window.partitionBy("range").orderBy("key", "bound").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = written.withColumn("open", F.last("open", True).over(within)).where("bound = 0")
    return swept.join(F.broadcast(carried), "range").withColumn("open", F.coalesce("open", "carried")).drop("bound", "range", "carried")


def judge_urls(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", ranges: int | None = None) -> DataFrame:
    """Every row of ``urls`` with host, path, rule and verdict.

    rules: host, path and action (allow or block; anything else allows). A rule
    fits its host and all subdomains if the url's path begins with the rule's.
    The longest wins, counted in characters of host and path together, then of
    the host; the same host and path with both actions blocks. ``rule`` is host
    and path of the winner, else null, and then the verdict is ``default``.

    Null urls and urls without ``://`` have an empty host and path and no rule
    unless one has an empty host. Repeated rows stay, each judged alike. Other
    columns stay; columns named host, path, rule or verdict are replaced. An
    empty table of rules gives ``default`` throughout. ranges: the number of
    key ranges of a sweep, by default four a shuffle partition.
    """
    n = ranges or 4 * partitions(urls.sparkSession)
    kept = [c for c in urls.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(1).alias("_"))
    told = urls.select(F.monotonically_increasing_id().alias("id"), row.alias("row"), host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    clean = cut(clean_rules(rules), "url-rules")
    by_host = sweep(told.withColumn("key", host_key(F.col("host"))), host_bounds(clean), n).drop("key")
    asked = by_host.withColumn("at", F.explode_outer("open")).drop("open")
    asked = asked.withColumn("key", F.coalesce(path_key(F.col("at"), F.col("path")), F.lit("").cast("binary"))).drop("at")
    judged = sweep(asked, path_bounds(clean), n).select("id", "row", "host", "path", F.get("open", F.lit(0)).alias("rule"))
    best = judged.groupBy("id").agg(F.first("row").alias("row"), F.first("host").alias("host"), F.first("path").alias("path"), F.max("rule").alias("best"))
    return best.select(
        *[F.col(f"row.`{c}`").alias(c) for c in kept], "host", "path",
        F.concat("best.host", "best.path").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"),
    )
