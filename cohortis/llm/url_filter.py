"""URL filter: explicit rules, then empirical-Bayes reputation of hosts, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortis.llm.common import Scratch, ascii_lower

# Pairs of labels that count as one public suffix; a caller passes the list that fits its pages.
SUFFIXES = ("ac.uk", "co.jp", "co.uk", "com.au", "com.br", "gov.uk", "org.uk")
MIN_RHO, MAX_RHO = 1e-4, 0.5  # bounds of the estimated correlation of outcomes within a group


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): what follows the first ``://``; both empty for a null url or one without it."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))), F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule (verdict, host, path) that fits, or null.

    A rule fits its host and all its subdomains where the path starts with the rule's path.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
                       ).otherwise(found)
    return found


PORT, ADDRESS = r":[0-9]*$", r"^[0-9]+(\.[0-9]+){3}$"


def suffix_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The last label, or two if they are listed; a port is left out, an IPv4 address is its own suffix."""
    name = F.regexp_replace(host, PORT, "")
    two = F.substring_index(name, ".", -2)
    return F.when(name.rlike(ADDRESS), name).when(two.isin(*suffixes), two).otherwise(F.substring_index(name, ".", -1))


def domain_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The registered domain: one label more than the suffix."""
    name = F.regexp_replace(host, PORT, "")
    two = F.substring_index(name, ".", -2)
    return F.when(name.rlike(ADDRESS), name).when(two.isin(*suffixes), F.substring_index(name, ".", -3)).otherwise(two)


def _shrunk(children: DataFrame, parent: str) -> DataFrame:
    """``mean`` and ``strength`` of each child's posterior, its prior centred on the parent's mean.

    The prior's strength is kappa = 1 / rho - 1, rho being the moment estimate of the correlation of outcomes within a
    child: E[(bad - n m)^2] = n m (1 - m) (1 + (n - 1) rho) in a beta-binomial.
    """
    m, n = F.col(parent), F.col("n")
    spread = F.pow(F.col("bad") - n * m, F.lit(2.0))
    fit = children.agg(F.sum(spread - n * m * (1 - m)).alias("over"), F.sum(n * (n - 1) * m * (1 - m)).alias("room"))
    rho = F.when(F.col("room") > 0, F.least(F.greatest(F.col("over") / F.col("room"), F.lit(MIN_RHO)), F.lit(MAX_RHO))
                 ).otherwise(F.lit(MAX_RHO))
    kappa = fit.select((1 / rho - 1).alias("kappa"))  # one row
    return (children.join(F.broadcast(kappa))
            .withColumn("mean", (F.col("bad") + F.col("kappa") * m) / (n + F.col("kappa")))
            .withColumn("strength", n + F.col("kappa")).drop("kappa"))


def host_reputation(outcomes: DataFrame, suffixes: tuple[str, ...] = SUFFIXES, z: float = 1.645) -> DataFrame:
    """Per host of ``outcomes`` (host string, bad 0/1/null): n, bad, mean, lower.

    A suffix shrinks to the mean of all pages, a domain to its suffix, a host to its domain. ``lower`` is the
    posterior mean less z posterior standard deviations. A host without labelled pages gets its domain's mean with the
    prior's strength alone. All labelled rows count; pages of one host are added up before they are shuffled.
    """
    scratch = Scratch(outcomes.sparkSession, "reputation")
    hosts = scratch.write("hosts", outcomes.groupBy("host").agg(
        F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad"))
        .withColumn("domain", domain_of(F.col("host"), suffixes)).withColumn("suffix", suffix_of(F.col("host"), suffixes)))
    added = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = scratch.write("domains", hosts.groupBy("domain", "suffix").agg(*added))
    tops = scratch.write("tops", domains.groupBy("suffix").agg(*added))
    overall = tops.agg((F.sum("bad") + 0.5).alias("b"), (F.sum("n") + 1.0).alias("t")).select(
        (F.col("b") / F.col("t")).alias("prior"))
    # A level is used twice, by its fit and by its rows, so each is written once.
    tops = _shrunk(scratch.write("tops_prior", tops.join(F.broadcast(overall))), "prior").select("suffix", F.col("mean").alias("prior"))
    placed = scratch.write("domains_prior", domains.join(tops, "suffix"))
    domains = _shrunk(placed, "prior").select("domain", F.col("mean").alias("prior"))
    shrunk = _shrunk(scratch.write("hosts_prior", hosts.join(domains, "domain")), "prior")
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("strength") + 1))
    return shrunk.select("host", "n", "bad", "mean", (F.col("mean") - F.lit(z) * sd).alias("lower"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", bad: str = "bad",
                most_bad: float = 0.3, suffixes: tuple[str, ...] = SUFFIXES, z: float = 1.645) -> DataFrame:
    """``pages`` with host, path, rule, verdict, bad_rate and bad_lower (columns of these names are replaced).

    ``bad`` marks labelled pages (1 bad, 0 good, null unlabelled). The verdict is that of the longest rule that fits;
    else a host is blocked if even the lower posterior bound of its share of bad pages is over ``most_bad``, so a host
    with few labels is not blocked on chance. Ports belong to the host, but not to its domain. A null or broken url has an empty host and path and is judged as the
    host ''. An empty table gives none.
    """
    host, path = url_parts(F.col(url))
    made = ("host", "path", "rule", "verdict", "bad_rate", "bad_lower", "__host", "__rule")
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in made]
    parsed = pages.select(*kept, host.alias("host"), path.alias("path"), F.col(bad).cast("int").alias("__bad"))
    reputation = host_reputation(parsed.select("host", F.col("__bad").alias("bad")), suffixes, z).select(
        F.col("host").alias("__host"), F.col("mean").alias("bad_rate"), F.col("lower").alias("bad_lower"))
    found = matching_rule(F.col("host"), F.col("path"), rules)
    judged = parsed.join(reputation, F.col("host") == F.col("__host"), "left").drop("__host", "__bad").withColumn("__rule", found)
    by_method = F.when(F.col("bad_lower") > most_bad, "block").otherwise("allow")
    return (judged.withColumns({"rule": F.col("__rule.rule"),
                                "verdict": F.coalesce(F.col("__rule.verdict"), by_method)}).drop("__rule"))
