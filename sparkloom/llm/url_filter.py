"""URL filters: host-suffix and path-prefix expressions joined to rules on short hash prefixes.

A rule is (host, path, verdict). It fits a URL whose host is the rule's or a subdomain of it and whose path starts with
the rule's. Of the rules that fit, the longest (host and path together) wins; of two as long, the one with the longer
host. For a (host, path) that is listed with both verdicts, ``block`` holds.

Every URL is expanded into the expressions that any rule could equal: the host's last k labels, a slash (which no host
holds, so that what is host and what is path can't be mistaken) and the path's first n characters, for the (k, n) shapes that occur among the rules. Expressions meet rules in an equi-join on the
first 8 hex digits of their SHA-256; the full digest then confirms, as in safe-browsing lists. No expression is made for
shapes that no rule has, so a long path costs no more than a short one.

Defined cases: a null URL, or one without ``://``, has an empty host and path and fits no rule; rules whose host is null,
empty or holds what ends a host are ignored, a null rule path counts as empty; repeated pages each get their row; an empty table gives an
empty result. Columns of the page table other than the two used are neither read nor returned.

The rules are broadcast while they are at most ``BROADCAST_RULES`` (about 200 bytes each); beyond that they are
replicated over ``SALTS`` salts and joined by shuffle, so that an expression of a hot host is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import ascii_lower

BROADCAST_RULES = 100_000
SALTS = 32


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def _prepared(rules: DataFrame) -> DataFrame:
    """One row per (host, path): labels of the host, expression, digest, prefix, verdict."""
    r = rules.select(ascii_lower(F.col("host")).alias("rh"), F.coalesce("path", F.lit("")).alias("rp"), F.col("verdict").alias("rv"))
    r = r.filter(F.col("rh").rlike("^[^/?#]+$") & F.col("rv").isNotNull()).groupBy("rh", "rp").agg(F.max("rv").alias("rv"))
    r = r.withColumn("rule", F.concat("rh", "rp")).withColumn("digest", F.sha2(F.concat_ws("/", "rh", "rp"), 256))
    return r.select("rh", "rule", "rv", "digest", F.substring("digest", 1, 8).alias("prefix"), F.size(F.split("rh", r"\.")).alias("k"), F.char_length("rp").alias("n"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """Returns page_id, host, path, rule (null if none fits), verdict, for every page."""
    ready = _prepared(rules)
    shapes = [(x["k"], x["n"]) for x in ready.select("k", "n").distinct().collect()]  # at most labels x lengths of the rules
    many = ready.limit(broadcast_rules + 1).count() > broadcast_rules
    p = pages.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if not shapes:
        return p.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    listed = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("n")) for k, n in sorted(shapes)])
    labels, length = F.size(F.split("host", r"\.")), F.char_length("path")
    fits = F.filter(listed, lambda s: (s["k"] <= labels) & (s["n"] <= length))
    tail = lambda k: F.array_join(F.slice(F.split(F.col("host"), r"\."), labels - k + 1, k), ".")
    expressions = F.transform(fits, lambda s: F.concat(tail(s["k"]), F.lit("/"), F.substring(F.col("path"), F.lit(1), s["n"])))
    e = p.withColumn("expression", F.explode_outer(expressions)).withColumn("full", F.sha2("expression", 256)).withColumn("short", F.substring("full", 1, 8))
    confirmed = F.col("full") == F.col("digest")
    if many:
        e = e.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(SALTS)))
        r = ready.withColumn("rsalt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        met = e.join(r, (e["short"] == r["prefix"]) & (e["salt"] == r["rsalt"]) & confirmed, "left")
    else:
        met = e.join(F.broadcast(ready), (e["short"] == ready["prefix"]) & confirmed, "left")
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct(F.char_length("rule").alias("l"), F.char_length("rh").alias("h"), "rule", "rv")))
    judged = met.groupBy("uid", "page_id", "host", "path").agg(best.alias("best"))
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rv", F.lit(default)).alias("verdict"))


#: The rules of the registered query.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def rules_of(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES " + ", ".join(str(r) for r in RULES) + " AS r(host, path, verdict)")
