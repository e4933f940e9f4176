"""URL filtering by rules and by an empirical-Bayes reputation of hosts.

Labelled page outcomes are summed by host, registered domain and suffix. Each level is shrunk towards its parent by a
beta-binomial prior whose strength is estimated by the method of moments from the level itself. A host passes when the
lower bound of its posterior reaches the threshold. Everything is an aggregate or an equi-join; only three strengths and
the overall totals come to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowkit.llm.common import checkpoint

#: (verdict, host, path) of the contract's rules.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Public suffixes of several labels, under which anyone registers; all others are the last label. Callers may pass a longer list.
SUFFIXES = (
    "ac.jp", "ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.hk", "com.mx", "com.sg", "com.tr", "com.tw",
    "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk",
)
#: A host passes when mean - Z * deviation of its posterior is at least LEAST.
Z, LEAST = 1.645, 0.5
#: Bounds of the estimated intra-class correlation.
RHO = (0.001, 0.5)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty if there is no :// or no url."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty if there is no :// or no url."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits the host or a domain above it and starts the path, and its verdict; nulls if none fits."""
    name = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def _bare(host: Column) -> Column:
    """A host without user info, port and trailing dots."""
    return F.regexp_replace(host, r"^.*@|:[0-9]*+$|(?<!\.)\.++(?::[0-9]*+)?$", "")


def _is_address(bare: Column) -> Column:
    return bare.rlike(r"^[0-9]+(?:\.[0-9]+){3}$|^\[")


def _levels(host: Column, suffixes: tuple[str, ...], more: int) -> Column:
    """The longest listed suffix of a host, else its last label, with so many labels before it. Addresses stay whole."""
    bare = _bare(host)
    out = F.when(_is_address(bare), bare)
    for k in sorted({x.count(".") + 1 for x in suffixes}, reverse=True):
        own = F.substring_index(bare, ".", -k)
        out = out.when(own.isin([x for x in suffixes if x.count(".") + 1 == k]), F.substring_index(bare, ".", -k - more))
    return out.otherwise(F.substring_index(bare, ".", -1 - more))


def domain_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The registered domain: one label before the public suffix."""
    return _levels(host, suffixes, 1)


def suffix_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    return _levels(host, suffixes, 0)


def _strength(units: DataFrame) -> float:
    """Prior strength from rows (n, k, p): trials, successes and the parent's mean."""
    spread = F.col("p") * (1 - F.col("p"))
    s = units.agg(
        F.sum((F.col("k") - F.col("n") * F.col("p")) ** 2).alias("seen"), F.sum(F.col("n") * spread).alias("within"), F.sum(F.col("n") * (F.col("n") - 1) * spread).alias("pairs")
    ).first()
    rho = (s["seen"] - s["within"]) / s["pairs"] if s["pairs"] else RHO[0]
    rho = min(max(rho, RHO[0]), RHO[1])
    return (1 - rho) / rho


def host_reputation(outcomes: DataFrame, z: float = Z, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """From rows (host, good): per host n, k, mean and the lower posterior bound.

    good is 1 or 0; null marks a page without a label, whose host still gets a posterior from the levels above. No labels
    at all: the uniform prior's mean of one half decides. An empty table gives no rows. User info, ports and trailing dots
    don't count for the levels above the host, and an address is its own domain and suffix.
    """
    hosts = outcomes.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("k"))
    hosts = checkpoint(hosts.withColumns({"domain": domain_of(F.col("host"), suffixes), "suffix": suffix_of(F.col("host"), suffixes)}))  # three strengths read it
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")).first()
    p0 = (total["k"] + 1) / (total["n"] + 2)

    suffixes = suffixes.withColumn("p", F.lit(p0))
    m = _strength(suffixes)
    suffixes = suffixes.select("suffix", ((F.col("k") + m * F.col("p")) / (F.col("n") + m)).alias("p"))
    domains = domains.join(suffixes, "suffix")
    m = _strength(domains)
    domains = domains.select("domain", ((F.col("k") + m * F.col("p")) / (F.col("n") + m)).alias("p"))
    hosts = hosts.join(domains, "domain")
    m = _strength(hosts)
    mean = (F.col("k") + m * F.col("p")) / (F.col("n") + m)
    hosts = hosts.select("host", "n", "k", mean.alias("mean"))
    return hosts.withColumn("bound", F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + m + 1)))


def judge_urls(pages: DataFrame, labels: DataFrame, rules=RULES, z: float = Z, least: float = LEAST, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict and bound for every page.

    A page's outcome is the label with its id: good is quality 1 and not toxic; of repeated labels the worst counts, null
    labels count as none. A url that is null or has no :// has empty host and path, and hosts that are alike share one
    reputation, the empty one too. Repeated pages give repeated rows.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    good = F.when((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0), 1).when(F.col("quality").isNotNull(), 0)
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("page_id")).agg(F.min(good).alias("good"))
    outcomes = rows.select("page_id", "host").join(marks, "page_id", "left")
    hosts = host_reputation(outcomes.select("host", "good"), z, suffixes).select("host", "bound")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    said = F.coalesce(verdict, F.when(F.col("bound") >= least, "allow").otherwise("block"))
    return rows.join(hosts, "host").select("page_id", "host", "path", rule.alias("rule"), said.alias("verdict"), F.round("bound", 6).alias("bound"))


#: Written for hosts under suffixes of one label, without ports and addresses, as all of the given tables are.
ORACLE = r"""
WITH pages_ AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
marks AS (SELECT doc_id AS page_id, min(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 WHEN quality IS NOT NULL THEN 0 END) AS good FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
hosts AS (SELECT host, count(good) AS n, coalesce(sum(good), 0) AS k,
                 array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix
          FROM pages_ LEFT JOIN marks USING (page_id) GROUP BY host),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT (sum(k) + 1) / (sum(n) + 2) FROM hosts) AS p FROM domains GROUP BY ALL),
r1 AS (SELECT least(greatest(coalesce((sum((k - n * p) ** 2) - sum(n * p * (1 - p))) / nullif(sum(n * (n - 1) * p * (1 - p)), 0), 0.001), 0.001), 0.5) AS rho FROM suffixes),
s2 AS (SELECT suffix, (k + (1 - rho) / rho * p) / (n + (1 - rho) / rho) AS p FROM suffixes, r1),
d1 AS (SELECT domains.*, s2.p FROM domains JOIN s2 USING (suffix)),
r2 AS (SELECT least(greatest(coalesce((sum((k - n * p) ** 2) - sum(n * p * (1 - p))) / nullif(sum(n * (n - 1) * p * (1 - p)), 0), 0.001), 0.001), 0.5) AS rho FROM d1),
d2 AS (SELECT domain, (k + (1 - rho) / rho * p) / (n + (1 - rho) / rho) AS p FROM d1, r2),
h1 AS (SELECT hosts.*, d2.p FROM hosts JOIN d2 USING (domain)),
r3 AS (SELECT least(greatest(coalesce((sum((k - n * p) ** 2) - sum(n * p * (1 - p))) / nullif(sum(n * (n - 1) * p * (1 - p)), 0), 0.001), 0.001), 0.5) AS rho FROM h1),
h2 AS (SELECT host, n, (1 - rho) / rho AS m, (k + (1 - rho) / rho * p) / (n + (1 - rho) / rho) AS mean FROM h1, r3),
h3 AS (SELECT host, mean - 1.645 * sqrt(mean * (1 - mean) / (n + m + 1)) AS bound FROM h2),
fits AS (
  SELECT page_id, host, path, bound,
         (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') AS a,
         (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') AS b,
         (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') AS c,
         (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') AS d,
         (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') AS e
  FROM pages_ JOIN h3 USING (host))
SELECT page_id, host, path,
       CASE WHEN c THEN 'example.org/en/1' WHEN b THEN 'example.org/es/' WHEN d THEN 'com/fr/' WHEN e THEN 'com/de/' WHEN a THEN 'org/' END AS rule,
       CASE WHEN c OR b OR e THEN 'block' WHEN d OR a THEN 'allow' WHEN bound >= 0.5 THEN 'allow' ELSE 'block' END AS verdict, round(bound, 6) AS bound
FROM fits
"""
