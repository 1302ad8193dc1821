"""URL filter: rules first, then the empirical-Bayes reputation of the host.

Labelled page outcomes (bad or not) are counted by host. Three nested levels of beta-binomial priors shrink them:

    suffix  ~ Beta(around the overall rate)          e.g. ``org``
    domain  ~ Beta(around its suffix's rate)         e.g. ``example.org``
    host    ~ Beta(around its domain's rate)         e.g. ``blog.example.org``

The strength of each level's prior comes from the data by the method of moments: with n_i outcomes and k_i bad ones in
child i of a parent with N, K and rate p,  S = sum(k_i^2/n_i) - K^2/N  has the expectation
p(1-p) [(1-rho)(m-1) + rho (N - sum(n_i^2)/N)], summed over all parents of the level; the prior's strength is
1/rho - 1, and rho is held between 0.0001 and 0.5. The rates above a host leave its own outcomes out, so that they count
once. A host's posterior is Beta(a, b) with a = strength * domain rate + bad, b = strength * (1 - domain rate) + good; its bound is mean - z * standard deviation.
A host is blocked if even this lower bound of its bad share is above ``max_bad``. A host without labels is judged by
its domain's prior alone.

Every statistic is an aggregate with partial sums (a hot host is combined before the shuffle); the three level strengths
are one row. Urls are joined with their host's verdict by host; a hot host's urls are spread over ``salts`` parts,
with one copy of the (small) host row for each part.

Defined cases: null urls and urls without ``://`` have an empty host and path and are judged as one host with the empty
name, whose domain and suffix are empty as well; a rule whose path isn't a prefix of the url's path doesn't fit (an
empty path fits no rule, as rules' paths begin with ``/``); of fitting rules the longest string wins, then the one that
comes first by code point; without any labels the overall rate is ``no_data_rate`` and nothing is blocked unless a
rule says so; repeated rows are judged alike, each; labels that repeat count each time; an empty table gives no rows.
Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from escalade.llm.common import ascii_lower, ready

#: Suffixes of two labels under which domains are registered, beside the plain last label.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn",
                      "com.mx", "com.tr", "com.tw", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")

RHO_MIN, RHO_MAX = 0.0001, 0.5


def host_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(ascii_lower(after), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _bare(host: Column) -> Column:
    """Without user and port."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")


def suffix_of(host: Column) -> Column:
    labels = F.split(_bare(host), r"\.")
    two = F.concat_ws(".", F.slice(labels, -2, 2))
    plain = F.element_at(labels, -1)
    return (F.when(_bare(host).rlike(r"^[0-9.]+$"), _bare(host))
            .when((F.size(labels) >= 2) & two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(plain))


def domain_of(host: Column) -> Column:
    labels = F.split(_bare(host), r"\.")
    keep = F.when((F.size(labels) >= 2) & F.concat_ws(".", F.slice(labels, -2, 2)).isin(*TWO_LABEL_SUFFIXES), 3).otherwise(2)
    return (F.when(_bare(host).rlike(r"^[0-9.]+$"), _bare(host))
            .when(F.size(labels) <= keep, _bare(host))
            .otherwise(F.concat_ws(".", F.slice(labels, -keep, keep))))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The string of the longest rule that fits, else null. A rule is ``host/path``; it fits the host, its subdomains,
    and paths that begin with its path."""
    found = F.lit(None).cast("string")
    for rule in sorted({r for r, _ in rules}, key=lambda r: (-len(r), r))[::-1]:
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        found = F.when(fits, rule).otherwise(found)
    return found


def _strength(children: DataFrame, parent: str) -> DataFrame:
    """One row: the strength of the prior of a level, from (parent, n, k) of its children."""
    labelled = children.filter("n > 0")
    by = labelled.groupBy(parent).agg(
        F.count(F.lit(1)).alias("m"), F.sum("n").cast("double").alias("N"), F.sum("k").cast("double").alias("K"),
        F.sum(F.col("k") * F.col("k") / F.col("n")).alias("k2"),
        F.sum((F.col("n") * F.col("n")).cast("double")).alias("n2"))
    rate = F.col("K") / F.col("N")
    v = rate * (1 - rate)
    top = F.sum(F.col("k2") - F.col("K") * rate - v * (F.col("m") - 1))
    base = F.sum(v * (F.col("N") - F.col("n2") / F.col("N") - (F.col("m") - 1)))
    # without two labelled children that differ, nothing speaks against a strong prior
    rho = F.coalesce(F.when(base > 0, top / base), F.lit(RHO_MIN))
    rho = F.greatest(F.least(rho, F.lit(RHO_MAX)), F.lit(RHO_MIN))
    return by.agg((1 / rho - 1).alias("strength")).select(F.lit(1).alias("one"), "strength")


def host_reputation(hosts: DataFrame, max_bad: float = 0.5, z: float = 1.645, no_data_rate: float = 0.1) -> DataFrame:
    """(host, domain, suffix, n, k) with its posterior mean, lower bound and verdict.

    ``hosts`` has one row per host: n labelled outcomes, k bad ones (0 where there are none)."""
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    whole = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all_n"), F.coalesce(F.sum("k"), F.lit(0)).alias("all_k")).withColumn("one", F.lit(1))
    one_row = (whole.join(_strength(suffixes.withColumn("all", F.lit(1)), "all").withColumnRenamed("strength", "m_suffix"), "one")
               .join(_strength(domains, "suffix").withColumnRenamed("strength", "m_domain"), "one")
               .join(_strength(hosts, "domain").withColumnRenamed("strength", "m_host"), "one"))
    levels = F.broadcast(one_row)  # one row, by construction
    named = lambda rows, level: rows.withColumnsRenamed({"n": f"{level}_n", "k": f"{level}_k"})
    h = hosts.join(named(domains, "domain"), ["suffix", "domain"]).join(named(suffixes, "suffix"), "suffix")
    h = h.withColumn("one", F.lit(1)).join(levels, "one")

    # a prior is what the others say: the host's own outcomes are left out of every rate above it, they come in once, at the end
    def others(level: str) -> tuple[Column, Column]:
        return F.col(f"{level}_n") - F.col("n"), F.col(f"{level}_k") - F.col("k")

    n, k = others("all")
    rate = F.when(n > 0, k / n).otherwise(no_data_rate)
    for level in ("suffix", "domain"):
        n, k = others(level)
        rate = (F.col(f"m_{level}") * rate + k) / (F.col(f"m_{level}") + n)
    a, b = F.col("m_host") * rate + F.col("k"), F.col("m_host") * (1 - rate) + F.col("n") - F.col("k")
    mean = a / (a + b)
    bound = mean - F.lit(z) * F.sqrt(mean * (1 - mean) / (a + b + 1))
    return h.select("host", "domain", "suffix", "n", "k", mean.alias("bad_rate"), bound.alias("bad_bound"),
                    F.when(bound > max_bad, "block").otherwise("allow").alias("verdict"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id",
               url_col: str = "url", max_bad: float = 0.5, z: float = 1.645, salts: int = 16) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's n, bad_rate and bad_bound, for every row of ``pages``.

    ``rules``: (``host/path``, ``allow`` or ``block``). ``outcomes``: (host, bad) of labelled pages, bad is 0 or 1."""
    ready(pages.sparkSession)
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    labelled = outcomes.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("bigint")).alias("k"))
    named = rows.groupBy("host").agg(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("k"))
    hosts = (named.unionByName(labelled).groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
             .withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))))
    told = host_reputation(hosts, max_bad, z).select(
        "host", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "n", "bad_rate", "bad_bound",
        F.col("verdict").alias("method_verdict"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(salts)).cast("int"))
    rule = rule_for(F.col("host"), F.col("path"), rules)
    by_rule = F.lit(None).cast("string")
    for name, verdict in rules:
        by_rule = F.when(F.col("rule") == name, verdict).otherwise(by_rule)
    return (rows.withColumn("rule", rule).join(told, ["host", "salt"])
            .select("page_id", "host", "path", "rule", F.coalesce(by_rule, "method_verdict").alias("verdict"), "n",
                    "bad_rate", "bad_bound"))
