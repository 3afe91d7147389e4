"""URL rules by a distributed sweep over sorted keys.

A host becomes a key of its labels in reverse, each closed by a dot (`www.example.com` ->
`com.example.www.`), so a rule for a host and all its subdomains is an interval of keys, and the
intervals of all rules either nest or are apart. Points (urls) and interval borders are sorted
together over range partitions. A border sets the stack of intervals that are active after it; a
point takes the stack of the last border before it, and the first points of a partition take what
the partitions before have left behind. Equal keys may be cut between partitions, so a hot host is
spread out.

Rules have two prefixes. The first sweep, over hosts, gives each url the stack of rule hosts above it; the
second, over (rule host, path) for the hosts on that stack, gives the nested path rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideledger.session import durable

#: The last character: it has none after it.
TOP = "\U0010ffff"
#: Between host key and path.
GAP = "\x00"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; else empty."""
    rest = F.when(F.locate("://", url) > 0, F.substring_index(_after(url), "/", 1)).otherwise(F.lit(""))
    host = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def _after(url: Column) -> Column:
    return F.substring(url, F.locate("://", url) + 3, F.length(url))


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end; else empty."""
    rest = F.substring_index(F.substring_index(_after(url), "?", 1), "#", 1)
    path = F.when(F.locate("/", rest) > 0, F.substring(rest, F.locate("/", rest), F.length(rest))).otherwise(F.lit(""))
    return F.coalesce(F.when(F.locate("://", url) > 0, path), F.lit(""))


def host_key(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def after_prefix(prefix: Column) -> Column:
    """The least key above all keys that start with `prefix`: its last character is raised by one.

    Characters at the very top are dropped first; keys sort by code point, and surrogates are none.
    """
    rest = F.rtrim(prefix, F.lit(TOP))
    code = F.ascii(F.substring(rest, -1, 1))
    raised = F.when(code == 0xD7FF, 0xE000).otherwise(code + 1)
    char = F.decode(F.unhex(F.lpad(F.hex(raised), 8, "0")), "UTF-32")
    return F.concat(F.substring(rest, F.lit(1), F.length(rest) - 1), char)


def _chains(intervals: DataFrame) -> DataFrame:
    """Each interval's prefix with the stack of prefixes it lies in, itself last.

    An interval's ancestors are found by equality on its own leading parts, not by pairs.
    """
    lengths = F.explode(F.sequence(F.lit(1), F.length("prefix")))
    heads = intervals.select("prefix", lengths.alias("n")).withColumn("head", F.substring("prefix", F.lit(1), F.col("n")))
    found = heads.join(intervals.select(F.col("prefix").alias("head")), "head")
    return found.groupBy("prefix").agg(F.sort_array(F.collect_list("head")).alias("stack"))


def sweep(points: DataFrame, prefixes: DataFrame, partitions: int) -> DataFrame:
    """Adds `stack`, the nested prefixes of each point's `key`, outermost first.

    `points` has distinct keys or not; `prefixes` has one column `prefix`. Points outside every
    interval get an empty stack.
    """
    chains = _chains(prefixes.where("prefix is not null").distinct())
    opened = chains.select(F.col("prefix").alias("key"), F.lit(1).alias("kind"), "stack")
    closed = chains.select(after_prefix(F.col("prefix")).alias("key"), F.lit(0).alias("kind"),
                           F.slice("stack", F.lit(1), F.size("stack") - 1).alias("stack"))
    # equal keys: intervals close before others open and points come; an inner one before the one around it
    borders = opened.union(closed).withColumn("depth", F.when(F.col("kind") == 0, -F.size("stack")).otherwise(F.size("stack")))
    rows = points.withColumns({"kind": F.lit(2), "depth": F.lit(0), "stack": F.lit(None).cast("array<string>")})
    mixed = rows.unionByName(borders, allowMissingColumns=True)
    salt = F.xxhash64(*points.columns)
    order = ["key", "kind", "depth", "salt"]
    # written once: the borders of the ranges must not move between the two uses below
    dealt = durable(mixed.withColumn("salt", salt).repartitionByRange(partitions, *order)
                    .withColumn("part", F.spark_partition_id()))
    last = (dealt.where("kind != 2").groupBy("part")
            .agg(F.max_by("stack", F.struct("key", "kind", "depth")).alias("left")))
    # one row per partition
    carried = (dealt.select("part").distinct().join(last, "part", "left")
               .withColumn("before", F.last("left", ignorenulls=True).over(
                   Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
               .select("part", "before"))
    running = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    swept = dealt.withColumn("open", F.last("stack", ignorenulls=True).over(running)).where("kind = 2")
    empty = F.array().cast("array<string>")
    return (swept.join(durable(carried), "part", "left")
            .withColumn("stack", F.coalesce("open", "before", empty))
            .drop("open", "before", "kind", "depth", "salt", "part"))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict in place of columns of these names.

    `rules` has host (without a leading dot), path (starts with /) and verdict. The longest
    fitting rule wins (host and path together, then the longer host); of rules equal in host and
    path, the first verdict in the alphabet. Without one, rule is null and the verdict `default`.
    Null urls and urls without `://` have an empty host and path. Every row comes back once.
    Each distinct url is judged once.
    """
    spark = pages.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rules = (rules.where("host is not null and path is not null and host != ''")
             .groupBy("host", "path").agg(F.min("verdict").alias("rule_verdict"))
             .withColumn("host_key", host_key(F.col("host"))))
    urls = (pages.where(F.col(url).isNotNull()).groupBy(F.col(url).alias("__url")).agg(F.lit(1).alias("one"))
            .select("__url", host_key(host_of(F.col("__url"))).alias("key"), path_of(F.col("__url")).alias("__path")))
    hosts = rules.select(F.col("host_key").alias("prefix"))
    over_hosts = sweep(urls, hosts, partitions)
    pairs = over_hosts.select("__url", F.explode("stack").alias("host_key"), "__path")
    keyed = pairs.withColumn("key", F.concat("host_key", F.lit(GAP), "__path")).select("__url", "key")
    keys = rules.withColumn("prefix", F.concat("host_key", F.lit(GAP), "path"))
    fitting = (sweep(keyed, keys.select("prefix"), partitions).where(F.size("stack") > 0)
               .select("__url", F.element_at("stack", -1).alias("prefix")))
    best = (fitting.join(keys, "prefix")
            .groupBy("__url").agg(F.max(F.struct(
                (F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"),
                F.concat("host", "path").alias("rule"), F.col("rule_verdict").alias("verdict"))).alias("hit"))
            .select("__url", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("verdict")))
    plain = pages.drop("host", "path", "rule", "verdict")
    judged = plain.join(durable(best), F.col(url) == F.col("__url"), "left").drop("__url")
    return judged.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url)),
                               "verdict": F.coalesce("verdict", F.lit(default))})
