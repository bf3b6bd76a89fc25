"""URL filters: fixed rules first, empirical-Bayes host reputation for the rest. Built-in functions only.

A url's host is what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; its path
goes on from there up to ``?``, ``#`` or the end. A rule (host, path, verdict) fits its host and all subdomains if the url's
path starts with the rule's; the longest rule that fits decides. Rules are a parameter, compiled into one projection.

The other urls are judged by their host. Labelled pages say how many of a host's pages are bad, and a host with few of them
leans on its registered domain, a domain on its suffix, and a suffix on all pages: on each level the count of bad pages is
beta-binomial around the mean of the level above. How far it leans is not set but estimated: with n labelled pages of a member,
k of them bad, and m the mean above, E[(k - n m)^2] = n m (1 - m) (1 + (n - 1) rho), which gives rho over all members of the
level, and a prior worth 1 / rho - 1 pages. A host is blocked if the upper bound of its share of bad pages, ``z`` standard
deviations of the posterior above its mean, is over ``limit``.

Pages are counted by host with partial sums, so a host with a third of all pages is a row per task. Verdicts come back by a join
with the blocked hosts, a written table: Spark broadcasts it if it is small, and splits a hot host's pages if it is not.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule, and is judged as the host "" is; a page without
outcome counts for nothing; repeated page rows are pages each, repeated outcomes count each; null ids have no outcomes; without any
outcome the mean is one half; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import ascii_lower, staged

LIMIT, Z = 0.35, 1.645
#: A prior is worth 1 to 1,000 pages; 10 where no member of a level has two labelled pages.
RHO_MIN, RHO_MAX, RHO_UNKNOWN = 1 / 1001, 0.5, 1 / 11
# Suffixes of two labels under which domains are registered; all others are the last label.
TWO_LABELS = ("ac.jp", "ac.kr", "ac.uk", "co.id", "co.il", "co.in", "co.jp", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.hk", "com.mx", "com.my", "com.sg", "com.tr", "com.tw", "com.ua", "go.jp", "go.kr", "gov.au", "gov.br", "gov.cn", "gov.uk", "ne.jp", "net.au", "net.cn", "or.jp", "or.kr", "org.au", "org.br", "org.cn", "org.uk", "re.kr")


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]], give: str = "rule") -> Column:
    """The longest rule that fits as ``host`` + ``path``, or its verdict (``give="verdict"``); null if none does."""
    out = F.lit(None).cast("string")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.lit(h + p if give == "rule" else verdict)).otherwise(out)
    return out


def with_levels(d: DataFrame) -> DataFrame:
    """Adds ``domain`` and ``suffix`` of ``host``. An address in digits is its own domain, below the suffix ""."""
    name = F.regexp_replace(F.regexp_replace("host", "^.*@", ""), ":[0-9]*$", "")
    d = d.withColumn("_labels", F.split(name, r"\.", -1)).withColumn("_number", name.rlike(r"^[0-9.]+$|^\["))
    two = F.array_join(F.slice("_labels", -2, 2), ".")
    n = F.when((F.size("_labels") >= 2) & two.isin(*TWO_LABELS), 2).otherwise(1)
    last = lambda k: F.array_join(F.slice("_labels", F.greatest(F.lit(1), F.size("_labels") - k + 1), k), ".")
    suffix = F.when(F.col("_number"), "").otherwise(last(n))
    domain = F.when(F.col("_number"), name).otherwise(last(n + 1))
    return d.select("*", domain.alias("domain"), suffix.alias("suffix")).drop("_labels", "_number")


def _spread(level: DataFrame) -> float:
    """What a prior of this level is worth, in pages: its members have n, k, and the mean above as m."""
    e = F.col("n") * F.col("m") * (1 - F.col("m"))
    row = level.agg(F.sum(F.pow(F.col("k") - F.col("n") * F.col("m"), F.lit(2.0)) - e).alias("over"), F.sum(e * (F.col("n") - 1)).alias("room")).first()
    rho = row["over"] / row["room"] if row["room"] else RHO_UNKNOWN
    return 1 / min(max(rho, RHO_MIN), RHO_MAX) - 1


def _mean(worth: float) -> Column:
    return (F.col("k") + worth * F.col("m")) / (F.col("n") + worth)


def reputation(hosts: DataFrame, z: float = Z) -> DataFrame:
    """Adds ``mean`` and ``bound`` of the share of bad pages to hosts(host, n, k): n labelled pages, k of them bad."""
    sums = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    hosts = with_levels(hosts)
    domains = hosts.groupBy("suffix", "domain").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    all_n, all_k = (x or 0 for x in suffixes.agg(F.sum("n"), F.sum("k")).first())
    suffixes = suffixes.withColumn("m", F.lit((all_k + 1.0) / (all_n + 2.0)))
    above = suffixes.select("suffix", _mean(_spread(suffixes)).alias("m"))
    domains = domains.join(above, "suffix")
    above = domains.select("suffix", "domain", _mean(_spread(domains)).alias("m"))
    hosts = hosts.join(above, ["suffix", "domain"])
    worth = _spread(hosts)
    mean, size = _mean(worth), F.col("n") + worth
    return hosts.withColumn("mean", mean).withColumn("bound", F.col("mean") + z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (size + 1)))


def host_counts(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(host, n, k) for every host of ``pages``; ``outcomes`` has the columns page_id and bad (boolean)."""
    p = pages.select(F.col(f"`{id_col}`").alias("page_id"), host_of(F.col(f"`{url_col}`").cast("string")).alias("host"))
    o = outcomes.filter("bad is not null").groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("k"))
    return p.join(o, "page_id", "left").groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]], limit: float = LIMIT, z: float = Z, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per page: page_id, host, path, rule (null if none fits), verdict (allow or block)."""
    hosts = staged(host_counts(pages, outcomes, id_col, url_col), "hosts")
    blocked = staged(reputation(hosts, z).filter(F.col("bound") > limit).select("host", F.lit(True).alias("blocked")), "blocked")
    url = F.col(f"`{url_col}`").cast("string")
    p = pages.select(F.col(f"`{id_col}`").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    p = p.join(blocked, "host", "left")
    by_host = F.when(F.col("blocked"), "block").otherwise("allow")
    return p.select("page_id", "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("rule"), F.coalesce(rule_of(F.col("host"), F.col("path"), rules, "verdict"), by_host).alias("verdict"))
