"""Url filter: host rules, and empirical-Bayes host reputation for the rest.

A labelled page is an outcome (good or not) of its host.  Outcomes are summed
per host, registered domain (last two labels) and suffix (last label).  Each
level's beta prior is centred on the posterior mean of the level above, with
a strength estimated from how far the groups of the level scatter around
their parents (method of moments), so a host with few pages is drawn to its
domain and a host with many speaks for itself.  A page is blocked when even
the upper bound of its host's posterior good rate is below ``min_good``.

Pages meet reputation rows, one per host; the outcomes are pre-aggregated
(one partial row per host and task) and the join leaves a host with a third of
all pages to Spark's skew splitting.  Only page_id and url are read.

Cases: a null url, or one without "://", has host and path '' and is judged
as an unknown host; labels without a page, or null, are left out; several labels of a
page count each; repeated pages are each judged; with no labels at all the
prior is neutral and nothing is blocked; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salescope.llm.common import ascii_lower, lit_or_empty, stage

# Rule and verdict, longest fitting rule wins.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block",
         "org/fr/": "allow"}


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both '' without '://'."""
    rest = F.when(F.instr(lit_or_empty(url), "://") > 0,
                  F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    host = ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_of(host: Column, path: Column, rules: dict[str, str] = RULES) -> Column:
    """The longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=len):     # longer ones are tested first
        h, slash, p = rule.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) \
            & F.startswith(path, F.lit(slash + p))
        out = F.when(fits, rule).otherwise(out)
    return out


def labels_of(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix): the last two labels and the last one."""
    return F.substring_index(host, ".", -2), F.substring_index(host, ".", -1)


def _strength(groups: DataFrame, low: float = 1.0, high: float = 1000.0) -> float:
    """Beta prior strength of one level from ``n``, ``k`` and the parent mean
    ``m``: the scatter of k/n around m beyond binomial noise.  One row."""
    r = groups.agg(
        F.sum((F.col("k") - F.col("n") * F.col("m")) ** 2).alias("s"),
        F.sum(F.col("n") * F.col("m") * (1 - F.col("m"))).alias("b"),
        F.sum(F.col("n") * (F.col("n") - 1) * F.col("m") * (1 - F.col("m"))).alias("d")).first()
    if not r or not r["d"]:
        return high
    # E[(k - n m)^2] = n m (1 - m) (1 + (n - 1) rho), rho = 1 / (strength + 1)
    rho = (r["s"] - r["b"]) / r["d"]
    return min(high, max(low, 1.0 / rho - 1.0)) if rho > 0 else high


def reputation(outcomes: DataFrame) -> DataFrame:
    """host, posterior mean ``good_rate`` and its ``good_upper`` parameters,
    from rows (host, good 0/1).  One row per labelled host."""
    domain, suffix = labels_of(F.col("host"))
    hosts = stage(outcomes.groupBy("host").agg(
        F.count("good").alias("n"), F.sum("good").alias("k"))
        .select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "k"), "host-counts")
    total = hosts.agg(F.sum("n"), F.sum("k")).first()
    mean = (total[1] + 1.0) / (total[0] + 2.0) if total[0] else 0.5

    def level(counts: DataFrame, key: str) -> DataFrame:
        """Posterior of one level given parent mean ``m``: adds alpha, beta."""
        s = _strength(counts)
        return counts.withColumn("alpha", F.col("k") + F.lit(s) * F.col("m")) \
                     .withColumn("beta", F.col("n") - F.col("k") + F.lit(s) * (1 - F.col("m")))

    def post(df: DataFrame) -> Column:
        return F.col("alpha") / (F.col("alpha") + F.col("beta"))

    def up(key: str, *more: str) -> DataFrame:
        return hosts.groupBy(key, *more).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))

    suffixes = stage(level(up("suffix").withColumn("m", F.lit(mean)), "suffix"), "suffix-rep")
    domains = level(up("domain", "suffix").join(
        suffixes.select("suffix", post(suffixes).alias("m")), "suffix"), "domain")
    domains = stage(domains, "domain-rep")
    ranked = level(hosts.join(domains.select("domain", post(domains).alias("m")), "domain"),
                   "host")
    return stage(ranked.select("host", "n", "k", "alpha", "beta"), "host-rep")


def judge_urls(pages: DataFrame, labels: DataFrame, rules: dict[str, str] = RULES,
               min_good: float = 0.5, z: float = 1.645) -> DataFrame:
    """page_id, host, path, rule, verdict (and the reputation behind it).

    ``labels`` has doc_id (the page's id), quality and toxic; a page is good
    if its quality is 1 and it is not toxic.  The bound is the normal
    approximation of the beta posterior's upper quantile."""
    host, path = url_parts(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    good = F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)
    marked = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL") \
                   .select(F.col("doc_id").alias("_id"), good.alias("good"))
    rep = reputation(parsed.join(marked, F.col("page_id") == F.col("_id"))
                     .where("host <> ''").select("host", "good"))
    mean = F.col("alpha") / (F.col("alpha") + F.col("beta"))
    sd = F.sqrt(mean * (1 - mean) / (F.col("alpha") + F.col("beta") + 1))
    bound = rep.select(F.col("host").alias("_h"), F.col("n").alias("n_labelled"),
                       mean.alias("good_rate"),
                       F.least(F.lit(1.0), mean + z * sd).alias("good_upper"))
    rule = rule_of(F.col("host"), F.col("path"), rules)
    by_rule = F.lit(None).cast("string")
    for r, v in rules.items():
        by_rule = F.when(F.col("rule") == r, v).otherwise(by_rule)
    by_host = F.when(F.coalesce(F.col("good_upper") < min_good, F.lit(False)), "block") \
               .otherwise("allow")
    return (parsed.withColumn("rule", rule)
            .join(bound, F.col("host") == F.col("_h"), "left")
            .select("page_id", "host", "path", "rule",
                    F.coalesce(by_rule, by_host).alias("verdict"),
                    F.coalesce("n_labelled", F.lit(0)).alias("n_labelled"),
                    "good_rate", "good_upper"))
