"""URL filter: stated rules first, then empirical-Bayes host reputation (host, registered domain, suffix, all pages)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut

#: (verdict, host, path) of the rules in force.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Labels that, before a country's two letters, make a suffix under which names are registered ("co.uk"). All other suffixes have one label.
SECOND_LABELS = ("ac", "co", "com", "edu", "go", "gob", "gov", "mil", "ne", "net", "nom", "or", "org", "sch")
#: An IPv4 or bracketed IPv6 address: each is a domain of its own, and all share one suffix.
ADDRESS = r"^(?:\d{1,3}(?:\.\d{1,3}){3}|\[[0-9a-f:.]*\])$"
ADDRESSES = "(address)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z folded. Path: then up to ``?``, ``#`` or end. Both empty without ``://``."""
    there = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substr(url, F.instr(url, "://") + 3)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(there, F.translate(host, UPPER, LOWER)).otherwise(""), F.when(there, path).otherwise("")


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, or nulls; rules are a short list of the caller's, so they are literals of the plan."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, of, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == of) | F.endswith(host, F.lit("." + of))) & F.startswith(path, F.lit(start))
        found = F.when(fits, F.struct(F.lit(of + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _strength(groups: DataFrame) -> tuple[float, float]:
    """Of groups with n outcomes and x bad ones: the overall rate, and the beta prior's strength by moments (its intra-class correlation)."""
    sums = groups.agg(F.count("*"), F.sum("n"), F.sum("x"), F.sum(F.col("n") * F.col("n")), F.sum(F.col("x") * F.col("x") / F.col("n"))).first()
    k, n, x, n2, ss = (float(v or 0) for v in sums)
    p = x / n if n else 0.0
    within, spare = p * (1 - p), n - (n2 / n if n else 0) - (k - 1)
    rho = ((ss - x * p) - within * (k - 1)) / (within * spare) if within > 0 and spare > 0 else 0.0
    rho = min(max(rho, 1e-3), 0.99)
    return p, (1 - rho) / rho


def domain_and_suffix(host: Column, suffixes: tuple[str, ...] = ()) -> tuple[Column, Column]:
    """The registered domain of a host and the suffix it is registered under; ``suffixes`` are more suffixes of two labels, as a list of public suffixes has them."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")
    two, address = F.substring_index(bare, ".", -2), F.rlike(bare, F.lit(ADDRESS))
    long = F.rlike(two, F.lit(rf"^(?:{'|'.join(SECOND_LABELS)})\.[a-z]{{2}}$")) | (two.isin(*suffixes) if suffixes else F.lit(False))
    suffix = F.when(address, ADDRESSES).when(long, two).otherwise(F.substring_index(bare, ".", -1))
    return F.when(address, bare).when(long, F.substring_index(bare, ".", -3)).otherwise(two), suffix


def host_reputation(pages: DataFrame, labels: DataFrame, *, z: float = 1.645, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """(host, n, x, rate, low): posterior mean and lower bound of each host's rate of bad pages.

    ``pages`` has (page_id, host) and ``labels`` (page_id, bad). Outcomes are summed per host and from there per registered domain and suffix.
    From the top down each level's rate is shrunk towards the level above by a beta-binomial prior whose strength is
    estimated from that level's groups; ``low`` is the host's posterior mean less ``z`` posterior standard deviations.
    Hosts without labels have the prior of their domain. Only one row of sums per level reaches the driver.
    """
    bad = labels.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    seen = pages.join(cut(bad), "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("x"))
    domain, suffix = domain_and_suffix(F.col("host"), suffixes)
    hosts = cut(seen.select("host", "n", "x", domain.alias("domain"), suffix.alias("suffix")))
    domains = cut(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x")))
    suffixes = cut(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x")))
    mean, k_suffix = _strength(suffixes.where("n > 0"))
    _, k_domain = _strength(domains.where("n > 0"))
    _, k_host = _strength(hosts.where("n > 0"))
    top = cut(suffixes.select("suffix", ((F.col("x") + k_suffix * mean) / (F.col("n") + k_suffix)).alias("above")))
    mid = cut(domains.join(top, "suffix").select("domain", ((F.col("x") + k_domain * F.col("above")) / (F.col("n") + k_domain)).alias("prior")))
    a = F.col("x") + k_host * F.col("prior")
    b = F.col("n") - F.col("x") + k_host * (1 - F.col("prior"))
    rate, spread = a / (a + b), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return hosts.join(mid, "domain").select("host", "n", "x", rate.alias("rate"), (rate - z * spread).alias("low"))


def filter_urls(pages: DataFrame, labels: DataFrame, *, rules=RULES, max_bad: float = 0.5, z: float = 1.645, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_rate, bad_low) for every row of ``pages`` (page_id, url).

    The longest rule that fits decides. Where none fits, a page is blocked if the lower bound of its host's posterior
    rate of bad pages is over ``max_bad``, else allowed. ``labels`` has (page_id, bad); bad may be null (no outcome).

    An IP address is its own registered domain. Empty tables give no rows, or pages without outcomes. Null url, or one without ``://``: host and path are empty, and all such pages share the reputation of the empty host.
    Null page ids have no outcome. Repeated rows each give a row (and each count once as an outcome). Other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    reputation = cut(host_reputation(parsed.select("page_id", "host"), labels, z=z, suffixes=suffixes).select("host", F.col("rate").alias("bad_rate"), F.col("low").alias("bad_low")))
    judged = parsed.join(reputation, "host", "left").withColumn("hit", matching_rule(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("bad_low") > max_bad, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", own).alias("verdict"), "bad_rate", "bad_low")
