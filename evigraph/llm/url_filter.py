"""URL filters: host-suffix and path-prefix expressions joined to rules by short hashes (DataFrame functions only).

A rule is (host, path, verdict). It fits a URL whose host is the rule's host or a subdomain of it
and whose path starts with the rule's path. Each URL is expanded to every expression a fitting rule
could have: its host suffixes at label borders, of as many labels as rule hosts have, times its path
prefixes at the lengths that rule paths have. So a host of thousands of labels has few. Expressions meet rules on 8 hexadecimal digits of SHA-256; the full digest confirms.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import let

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this many are broadcast (about 200 bytes each); more are joined by a salted shuffle.
BROADCAST_RULES = 20_000
SALTS = 16


def url_host(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty for null or no "://"."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to "?", "#" or the end; empty for null or no "://"."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column, labels: Sequence[int]) -> Column:
    """What ends the host and has one of these numbers of labels; the host itself if it has."""
    wanted = F.array(*[F.lit(n) for n in sorted(labels)]).cast("array<int>")
    return let(F.split(host, r"\."), lambda x: F.transform(F.filter(wanted, lambda n: n <= F.size(x)), lambda n: F.array_join(F.slice(x, F.size(x) - n + 1, n), ".")))


def expression(host: Column, path: Column) -> Column:
    """Digest of one rule expression; the line feed keeps host and path apart."""
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row a page: id, url, host, path, rule, verdict.

    rules: host, path, verdict. The longest fitting rule (host and path together, then host) wins;
    of rules alike in host and path "block" wins. rule is host and path together, null where none
    fits, and verdict is then `default`. Rows of rules with a null host, path or verdict never fit.

    Null url or one without "://": empty host and path, so no rule with a host fits. Null and
    repeated ids: each row is judged alike, and rows alike in id and url come out as often as they
    came in. Empty pages: no rows. Other columns are not read.
    """
    known = rules.select(F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")).na.drop()
    known = known.groupBy("r_host", "r_path").agg(F.max(F.struct((F.col("r_verdict") == "block").alias("b"), "r_verdict"))["r_verdict"].alias("r_verdict"))
    known = known.withColumn("r_digest", expression(F.col("r_host"), F.col("r_path"))).withColumn("prefix", F.substring("r_digest", 1, 8))
    # at most one number for each length that a rule's path has, and each number of labels of its host
    lengths = [r[0] for r in known.select(F.length("r_path").alias("n")).distinct().collect()]
    labels = [r[0] for r in known.select(F.size(F.split("r_host", r"\.")).alias("n")).distinct().collect()]

    # rows alike are judged once and multiplied at the end; both aggregations share one shuffle
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).groupBy("page_id", "url").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("host", url_host(F.col("url"))).withColumn("path", url_path(F.col("url")))
    prefixes = F.transform(F.filter(F.array(*[F.lit(n) for n in sorted(lengths)]).cast("array<int>"), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    digests = F.flatten(F.transform(host_suffixes(F.col("host"), labels), lambda h: F.transform(prefixes, lambda p: expression(h, p))))
    tried = rows.select("*", F.explode_outer(digests).alias("digest")).withColumn("prefix", F.substring("digest", 1, 8))
    if known.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        met = tried.join(F.broadcast(known), "prefix", "left")
    else:
        salted = tried.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        spread = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = salted.join(spread, ["prefix", "salt"], "left").drop("salt")
    fits = F.col("digest") == F.col("r_digest")
    rank = F.struct((F.length("r_host") + F.length("r_path")).alias("length"), F.length("r_host").alias("host_length"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))
    best = met.groupBy("page_id", "url").agg(F.first("host").alias("host"), F.first("path").alias("path"), F.first("n").alias("n"), F.max(F.when(fits, rank)).alias("best"))
    return best.select("page_id", "url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")).drop("copy")
