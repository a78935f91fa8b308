"""Allow and block rules for page addresses: a sort-merge range join in DataFrame operations only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window, functions as F

from rekurve.llm.common import range_index, range_splits, width

RANGES_PER_PARTITION = 2
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    after = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(F.coalesce(after, F.lit("")), r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    after = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    return F.coalesce(F.regexp_extract(after, r"^[^/?#]*(/[^?#]*)?", 1), F.lit(""))


def _key(labels: Column, path: Column) -> Column:
    """Labels from the last to the first, each ended by a dot, then ``/`` and the path; bytes, so that Spark sorts them as such."""
    return F.concat(F.array_join(labels, "."), F.lit("./"), path).cast("binary")


def _reversed(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def judge_pages(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = DEFAULT) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages(page_id, url string)``.

    The curve project keeps no records with addresses, so this is general.  ``rules(host, path, verdict)``: a rule fits its host and all
    subdomains if the path starts with the rule's; the longest rule (host and path together, then host) wins; of two verdicts for one
    rule ``block`` holds; rules with a missing field are ignored.  ``rule`` is host and path of the winner or null, and then ``verdict`` is
    ``default``.  A missing address, or one without ``://``, has an empty host and path.  Repeated rows keep a row each, other columns are
    ignored, empty tables give no rows or no rules.

    Every address gives one key for each number of labels that rules have: so many labels of the reversed host, then the path.  A rule
    is an interval of such keys.  Keys are cut into ranges of about equal size (equal keys by a hash of the page); in each range one
    ordered sweep passes the ends of intervals and the addresses.  An opening pushes its rule on the stack of nested rules, a closing
    brings back the one below, which each rule knows beforehand; a range starts with what is open at its first key.
    """
    spark = pages.sparkSession
    p = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    p = p.groupBy("page_id", "host", "path").agg(F.count(F.lit(1)).alias("copies"))
    r = rules.select("host", "path", "verdict").dropna().groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    labels = _reversed(F.col("host"))
    rule = F.struct(F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("host_size"), F.concat("host", "path").alias("rule"), "verdict").alias("top")
    r = r.select(F.size(labels).alias("depth"), _key(labels, F.col("path")).alias("start"), rule)
    depths = [x[0] for x in r.select("depth").distinct().orderBy("depth").collect()]  # at most the labels of a host name
    longest = r.agg(F.max(F.length("start"))).first()[0] or 0

    def enclosing(d: DataFrame, key: str, up_to: Column) -> DataFrame:
        """The longest rule whose key starts ``key`` and has at most ``up_to`` bytes."""
        cut = d.withColumn("cut", F.explode(F.sequence(F.lit(0), F.least(up_to, F.lit(longest)))))
        cut = cut.select(key, F.substring(F.col(key), F.lit(1), F.col("cut")).alias("start"))
        return cut.join(r.select("start", "top"), "start").groupBy(key).agg(F.max_by("top", F.length("start")).alias("below"))

    p = p.withColumn("labels", _reversed(F.col("host")))
    fitting = F.filter(F.array(*[F.lit(k) for k in depths]).cast("array<int>"), lambda k: k <= F.size("labels"))
    keyed = p.withColumn("depth", F.explode_outer(fitting)).withColumn("key", F.coalesce(_key(F.slice("labels", 1, F.coalesce("depth", F.lit(1))), F.col("path")), F.lit(b"")))
    keyed = keyed.withColumn("key", F.when(F.col("depth").isNull(), F.lit(b"")).otherwise(F.col("key")))
    keyed = keyed.withColumn("at", F.concat("key", F.lit(b"\0"), F.lpad(F.hex(F.xxhash64("page_id", "host", "path")), 16, "0").cast("binary")))
    splits = range_splits(keyed, F.col("at"), width(spark) * RANGES_PER_PARTITION)
    where = lambda c: range_index(c, splits)

    up = r.withColumn("key", F.col("start")).drop("start")
    up = up.join(enclosing(up, "key", F.length("key") - 1), "key", "left")
    opening = up.select(F.col("key").alias("at"), F.lit(1).alias("kind"), F.struct("top").alias("event"))
    closing = up.select(F.concat("key", F.lit(b"\xff")).alias("at"), F.lit(1).alias("kind"), F.struct(F.col("below").alias("top")).alias("event"))
    events = opening.unionByName(closing)
    if splits:
        first = spark.range(1).select(F.explode(F.array(*[F.lit(bytes(s)) for s in splits])).alias("key"))
        carried = enclosing(first, "key", F.length("key"))
        events = events.unionByName(carried.select(F.col("key").alias("at"), F.lit(0).alias("kind"), F.struct(F.col("below").alias("top")).alias("event")))
    same = ["page_id", "host", "path", "copies"]
    swept = keyed.select(*same, "at", F.lit(2).alias("kind")).unionByName(events, allowMissingColumns=True).withColumn("range", where(F.col("at")))
    order = Window.partitionBy("range").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = swept.withColumn("on_top", F.last("event", ignorenulls=True).over(order)).filter("kind = 2")
    best = swept.groupBy(*same).agg(F.max("on_top.top").alias("best"))
    out = best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
