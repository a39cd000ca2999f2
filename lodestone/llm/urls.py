"""URL filter: explicit rules first, else the empirical-Bayes reputation of the host.

Labelled page outcomes (bad or not) are counted by host. Beta-binomial priors shrink them level by
level: suffix towards the overall rate, registered domain towards its suffix, host towards its domain.
A page without a matching rule is blocked when the lower end of its host's posterior bad rate is above
``cutoff``, so a host falls only by enough evidence of its own or of its domain. Column functions only.

A url that is null or has no ``://`` has an empty host and path, which form a host of their own. Labels
that are null or belong to no page are not counted. Repeated rows are judged each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .shared import free_name, shared_table, small_or_plain

CUTOFF = 0.5
Z = 1.64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def registered_domain(host: Column) -> Column:
    """Last two labels of a host (the host itself if it has fewer)."""
    return F.substring_index(host, ".", -2)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, null where none does.

    ``rules`` are (verdict, "host/path"): configuration of a few hundred lines, compiled into one
    expression. Of equal rules the first counts.
    """
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    dotted = F.concat(F.lit("."), host)
    for kind, rule in sorted(reversed(list(rules)), key=lambda r: len(r[1])):  # the longest ends up outermost
        rule_host, slash, rule_path = rule.partition("/")
        fits = dotted.endswith("." + rule_host) & path.startswith(slash + rule_path)
        text, verdict = F.when(fits, F.lit(rule)).otherwise(text), F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def _strength(table: DataFrame, n: str, bad: str, mean: str) -> DataFrame:
    """One row: strength s of the beta prior of units with counts (n, bad) and prior means.

    Method of moments: squared deviations beyond the binomial part, bounded to 1..10,000.
    """
    labelled = table.where(F.col(n) > 0)
    m = F.col(mean)
    sums = labelled.agg(
        F.sum(F.col(n) * F.pow(F.col(bad) / F.col(n) - m, 2)).alias("v"), F.sum(m * (1 - m)).alias("b"),
        F.sum(F.col(n) * m * (1 - m)).alias("w"), F.sum(n).alias("n"),
    )
    between = F.greatest(F.try_divide(F.col("v") - F.col("b"), F.col("n")), F.lit(1e-9))
    s = F.least(F.greatest(F.try_divide(F.col("w"), F.col("n")) / between - 1, F.lit(1.0)), F.lit(10000.0))
    return sums.select(F.round(F.coalesce(s, F.lit(10000.0)), 6).alias("s"))


def host_reputation(pages: DataFrame, outcomes: DataFrame, z: float = Z) -> DataFrame:
    """Posterior of every host: host, n, bad, rate, low.

    ``pages``: page_id, host. ``outcomes``: page_id, bad (boolean), any number of labels per page.
    """
    labels = (
        outcomes.where(F.col("page_id").isNotNull() & F.col("bad").isNotNull())
        .groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    )
    hosts = (
        pages.select("page_id", "host").join(labels, "page_id", "left")
        .groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
        .withColumn("domain", registered_domain(F.col("host")))
        .withColumn("suffix", F.substring_index("domain", ".", -1))
    )
    hosts = shared_table(hosts, "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("bad").alias("dbad"))
    domains = shared_table(domains, "domains")
    suffixes = shared_table(domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dbad").alias("sbad")), "suffixes")
    overall = suffixes.agg(F.round(F.coalesce(F.try_divide(F.sum("sbad"), F.sum("sn")), F.lit(0.0)), 9).alias("m"))
    suffixes = suffixes.join(F.broadcast(overall))
    suffixes = suffixes.join(F.broadcast(_strength(suffixes, "sn", "sbad", "m"))).select(
        "suffix", ((F.col("sbad") + F.col("s") * F.col("m")) / (F.col("sn") + F.col("s"))).alias("sm")
    )
    suffixes = shared_table(suffixes, "suffix-rates")
    domains = domains.join(small_or_plain(suffixes), "suffix")
    domains = domains.join(F.broadcast(_strength(domains, "dn", "dbad", "sm"))).select(
        "domain", ((F.col("dbad") + F.col("s") * F.col("sm")) / (F.col("dn") + F.col("s"))).alias("dm")
    )
    domains = shared_table(domains, "domain-rates")
    hosts = hosts.join(small_or_plain(domains), "domain")
    hosts = hosts.join(F.broadcast(_strength(hosts, "n", "bad", "dm")))
    a = F.col("bad") + F.col("s") * F.col("dm")
    b = F.col("n") - F.col("bad") + F.col("s") * (1 - F.col("dm"))
    rate = a / (a + b)
    low = rate - z * F.sqrt(rate * (1 - rate) / (a + b + 1))
    return hosts.select("host", "n", "bad", F.round(rate, 9).alias("rate"), F.round(low, 9).alias("low"))


def filter_urls(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = (), cutoff: float = CUTOFF, z: float = Z
) -> DataFrame:
    """``pages`` (page_id, url, ...) with host, path, rule, verdict, host_rate; equal input names are replaced."""
    own = ("host", "path", "rule", "verdict", "host_rate")
    pages = pages.drop(*[c for c in pages.columns if c.lower() in own])
    parsed = pages.withColumn("host", url_host(F.col("url"))).withColumn("path", url_path(F.col("url")))
    reputation = shared_table(host_reputation(parsed, outcomes, z), "reputation")
    key, rate, low = (free_name(parsed, n) for n in ("_host", "_rate", "_low"))
    side = reputation.select(F.col("host").alias(key), F.col("rate").alias(rate), F.col("low").alias(low))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    by_host = F.when(F.col(low) > cutoff, F.lit("block")).otherwise(F.lit("allow"))
    return (
        parsed.join(small_or_plain(side), F.col("host") == F.col(key), "left")
        .withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, by_host))
        .withColumn("host_rate", F.col(rate)).drop(key, rate, low)
    )
