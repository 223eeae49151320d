"""URL filter lists as a sort-merge range join, in DataFrame operations only.

A rule (host, path) becomes the canonical key ``tld.domain.sub.`` + path, so that everything it covers under one host is the
key interval from the key itself to the key followed by a byte that no UTF-8 text has.  Prefix intervals are nested or
disjoint: at each interval start or end the innermost active rule is known from the rules alone (at an end it is the
nearest shorter rule), which is what a stack of active rules would have on top.  A URL is looked up once for each of its host
and parent domains; one sorted sweep over URL keys and interval ends gives each the top of the stack, and the longest of a
URL's rules wins.

A rule can only fit where a lookup has the rule's own host, so the sweep is dealt by host, and a host with many lookups by a salt as
well: no host, however common, gathers in one task, and only a common host's own rules are copied, once for each of its parts.
Lookups of hosts that no rule names aren't swept; a URL keeps one, by which it is told without a rule.

Defined results: a null URL or one without ``://`` has empty host and path and no rule; rules without host are ignored; of
rules with the same host and path, block wins; no rule gives the default verdict; repeated rows each get a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lookups of one host that a part of the sweep has, about.
PART_ROWS = 1 << 18

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _reversed(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def intervals(rules: DataFrame) -> DataFrame:
    """Events (domain, key binary, rule struct): from key on, up to the next event, rule is the innermost active one. domain: the rule's host as in a key."""
    clean = (
        rules.where(F.coalesce(F.col("host"), F.lit("")) != "")
        .select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action")
        .groupBy("host", "path")
        .agg(F.when(F.max((F.col("action") == "block").cast("int")) == 1, F.lit("block")).otherwise(F.max("action")).alias("action"))
        .withColumn("domain", _reversed(F.col("host")))
        .withColumn("key", F.concat("domain", "path"))
        .withColumn("rule", F.struct(F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("host_size"), F.concat("host", "path").alias("text"), "action"))
    )
    shorter = clean.select("key", F.explode(F.expr("transform(sequence(0, length(key) - 1), n -> left(key, n))")).alias("shorter"))
    parents = (
        shorter.join(clean.select(F.col("key").alias("shorter"), F.col("rule").alias("parent")), "shorter")
        .groupBy("key")
        .agg(F.max_by("parent", F.length("shorter")).alias("parent"))
    )
    both = clean.select("domain", "key", "rule").join(parents, "key", "left")
    return both.select("domain", F.inline(F.array(
        F.struct(F.col("key").cast("binary").alias("key"), F.col("rule")),
        F.struct(F.concat(F.col("key").cast("binary"), F.unhex(F.lit("FF"))).alias("key"), F.col("parent").alias("rule")),
    )))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict. rules: host, path, action (allow or block)."""
    urls = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"), F.monotonically_increasing_id().alias("row"))
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(F.reverse(labels), 1, n), "."), F.lit(".")))
    keys = urls.select("row", "page_id", "host", "path", F.posexplode(domains).alias("depth", "domain"))
    events = intervals(rules)
    # Of the hosts that rules name: how many parts their lookups need.
    often = keys.groupBy("domain").agg(F.count("*").alias("n"))
    named = events.select(F.col("domain").alias("_domain")).distinct().join(often, F.col("_domain") == F.col("domain")).select("_domain", F.ceil(F.col("n") / PART_ROWS).cast("int").alias("parts"))
    met = keys.join(named, F.col("domain") == F.col("_domain"), "left")
    swept = met.where("parts is not null or depth = 0")
    # A lookup without rules is dealt by its row, apart from all others.
    part = F.when(F.col("parts").isNull(), F.xxhash64("row")).otherwise(F.pmod(F.xxhash64("row"), F.col("parts")))
    group = F.when(F.col("parts").isNotNull(), F.col("domain"))
    probes = swept.select("row", "page_id", "host", "path", group.alias("group"), part.alias("part"), F.concat("domain", "path").cast("binary").alias("key"), F.lit(1).alias("kind"))
    marks = events.join(named, F.col("domain") == F.col("_domain")).select(F.col("domain").alias("group"), "key", F.lit(0).alias("kind"), F.struct("rule").alias("top"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("part"))
    order = Window.partitionBy("group", "part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tops = probes.unionByName(marks, allowMissingColumns=True).withColumn("top", F.last("top", ignorenulls=True).over(order)).where("kind = 1")
    best = tops.groupBy("row").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max("top.rule").alias("rule"))
    return best.select("page_id", "host", "path", F.col("rule.text").alias("rule"), F.coalesce("rule.action", F.lit(default)).alias("verdict"))
