"""URL filters: explicit rules, and host reputation where no rule fits.

Method: empirical Bayes. Labelled pages (outcome 1: bad, 0: good) are counted by host, registered
domain and suffix. Each level is a beta-binomial whose prior is the posterior of the level
above; how strongly it pulls is estimated from how much the units of the level differ. A host
is blocked if the lower bound of its posterior bad rate reaches a threshold, so a host of few
labels stands or falls with its domain.

Counts are combined before the shuffle; hosts join their pages by an ordinary join, so a host with
a third of all pages is split at run time, and nothing is broadcast by size.

Results by case: null urls and urls without "://" have empty host and path and share the
reputation of the empty host; a null outcome is no label; repeated pages count each; hosts
without a label have their domain's posterior; an empty table gives no rows. The registered
domain is the last two names of a host, the suffix its last one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A host is blocked from this lower bound of its bad rate on; the bound lies so many standard
#: deviations below the mean.
BLOCK_RATE, BOUND_SD = 0.25, 1.64
#: Range of the estimated prior strengths, in labels.
WEAKEST, STRONGEST = 2.0, 1000.0


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def domain_of(host: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit("")), host)


def suffix_of(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.]*)$", 1)


def best_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (verdict, "host/path") that fits, nulls if none does."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _level(counts: DataFrame, key: str, parent: DataFrame, on: list[str]) -> DataFrame:
    """counts (key, ..., n, bad) with `rate` and `weight` (labels plus prior) of the posterior.

    `parent` has the prior mean as `above`. The strength is the moment estimate of a
    beta-binomial: (1 - rho) / rho with rho the correlation within units.
    """
    joined = counts.join(parent, on) if on else counts.join(parent, F.lit(True))
    labelled = counts.filter("n > 0")
    sums = labelled.agg(
        F.count("*").alias("units"), F.sum("n").alias("total"), F.sum("bad").alias("all_bad"),
        F.sum(F.col("n") * F.col("n")).alias("squares"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("between"))
    p = F.col("all_bad") / F.col("total")
    spread = F.col("between") - F.col("all_bad") * p
    free = F.col("units") - 1
    size = F.col("total") - F.col("squares") / F.col("total") - free
    rho = (spread / (p * (1 - p)) - free) / size
    strength = sums.select(
        F.when((F.col("units") < 2) | (F.col("total") == 0), F.lit(STRONGEST))
        .when((F.col("all_bad") == 0) | (F.col("all_bad") == F.col("total")) | (size <= 0), F.lit(STRONGEST))
        .when(rho <= 1 / (1 + STRONGEST), F.lit(STRONGEST)).when(rho >= 1 / (1 + WEAKEST), F.lit(WEAKEST))
        .otherwise((1 - rho) / rho).alias("strength"))
    # One row of four numbers.
    m = strength.first()["strength"]
    m = STRONGEST if m is None else float(m)
    return joined.withColumn("weight", F.col("n") + F.lit(m)).withColumn(
        "rate", (F.col("bad") + F.lit(m) * F.col("above")) / F.col("weight"))


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """(host, rate, bound): posterior mean and lower bound of the bad rate of every host in
    outcomes (host, bad INT or null)."""
    hosts = (
        outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
        .withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    )
    hosts = stored(hosts, "host-counts")  # read by every level
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = (total["bad"] or 0) / total["n"] if total["n"] else 0.0
    top = outcomes.sparkSession.range(1).select(F.lit(float(overall)).alias("above"))
    suffixes = _level(suffixes, "suffix", top, []).select("suffix", F.col("rate").alias("above"))
    domains = _level(domains, "domain", suffixes, ["suffix"]).select("domain", F.col("rate").alias("above"))
    judged = _level(hosts, "host", domains, ["domain"])
    deviation = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("weight") + 1))
    return judged.select("host", "rate", (F.col("rate") - BOUND_SD * deviation).alias("bound"))


def _judged(rows: DataFrame, host: str, path: str, bad: str, rules: list[tuple[str, str]], names: tuple[str, str]) -> DataFrame:
    """rows with two more columns, the rule and the verdict, under the given names."""
    reputation = host_reputation(rows.select(F.col(host).alias("host"), F.col(bad).cast("int").alias("bad"))).select(
        F.col("host").alias(host), F.when(F.col("bound") >= BLOCK_RATE, "block").otherwise("allow").alias(names[1]))
    rule, verdict = best_rule(F.col(host), F.col(path), rules)
    joined = rows.join(reputation, host)
    return joined.withColumn(names[0], rule).withColumn(names[1], F.coalesce(verdict, F.col(names[1])))


def judge(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(page_id, host, path, rule, verdict) for pages (page_id, url, bad INT or null)."""
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "bad")
    return _judged(split, "host", "path", "bad", rules, ("rule", "verdict")).select("page_id", "host", "path", "rule", "verdict")


def keep_allowed(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """The allowed pages with all their columns; pages need `url` and `bad`. Every row is judged by its own url,
    so null and repeated ids, and columns of any other name, make no difference."""
    prefix = "judged_"
    while any(c.startswith(prefix) for c in pages.columns):
        prefix = "_" + prefix
    host, path = prefix + "host", prefix + "path"
    split = pages.withColumns({host: host_of(F.col("url")), path: path_of(F.col("url"))})
    judged = _judged(split, host, path, "bad", rules, (prefix + "rule", prefix + "verdict"))
    return judged.filter(F.col(prefix + "verdict") == "allow").select(*[f"`{c}`" for c in pages.columns])
