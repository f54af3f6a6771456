"""URL filters: rules first, and for all other pages the reputation of the host.

Labelled page outcomes (1 bad, 0 good) are counted per host and shrunk in steps: the suffix towards all
outcomes, the registered domain towards its suffix, the host towards its domain. Each step is a
beta-binomial prior with the parent's posterior mean; its strength is estimated from the spread of the
children's rates (method of moments), within [MIN_STRENGTH, MAX_STRENGTH]. A page is blocked when the lower
bound of its host's posterior, mean - Z * deviation, is over the threshold; else it is allowed. A host
without outcomes has its domain's posterior, and so on up.

The suffix of a host is its last label, or the last two where a country's label (of two letters) follows one of
`GENERIC`; the registered domain has one label more. Ports are left out of both; an address of numbers is its own domain
and suffix. The bound is that of a normal distribution with the posterior's mean and deviation.

Null url, or one without `://`: empty host and path, no rule, judged by the posterior of the empty host's
parents. A null outcome is none. Ties between rules cannot be: two fitting rules of one length are equal.
Repeated rows keep their rows; extra columns keep their names, but one named like an added column gets underscores at
its end. An empty table gives no rows. Hosts are counted once, as a table; pages of the hosts that have most are joined
with a broadcast of so many rows, so a hot host is not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import clear, join_hot, materialize

Z, THRESHOLD = 1.0, 0.5
MIN_STRENGTH, MAX_STRENGTH = 2.0, 200.0
#: Labels under which a country's names are registered.
GENERIC = ("ac", "co", "com", "edu", "gob", "gov", "go", "mil", "ne", "net", "nic", "or", "org")
PORT, NUMBERS, COUNTRY = ":[0-9]*$", r"^[0-9.]+$|^\[", f"(^|[.])({'|'.join(GENERIC)})[.][a-z][a-z]$"


def host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tail(host: Column, labels: int) -> Column:
    """The suffix of a host, or with labels = 1 its registered domain."""
    name = F.regexp_replace(host, PORT, "")
    two = F.substring_index(name, ".", -2 - labels)
    return F.when(name.rlike(NUMBERS), name).when(name.rlike(COUNTRY), two).otherwise(F.substring_index(name, ".", -1 - labels))


def rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, or null. rules: `host/path` to verdict."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r), r)):
        h, _, p = r.partition("/")
        out = F.when(((host == h) | host.endswith("." + h)) & path.startswith("/" + p), F.lit(r)).otherwise(out)
    return out


def strength(children: DataFrame) -> Column:
    """Method of moments over children (x of n bad, mean m of the parent): an aggregate."""
    n, x, m = F.col("n"), F.col("x"), F.col("m")
    spread = F.sum((x / n - m) * (x / n - m))
    least, more = F.sum(m * (1 - m) / n), F.sum((1 - 1 / n) * m * (1 - m))
    rho = (spread - least) / F.nullif(more, F.lit(0.0))  # correlation of outcomes within a child
    k = 1 / F.nullif(rho, F.lit(0.0)) - 1
    return F.when(more.isNull() | (more <= 0), F.lit(MIN_STRENGTH)).when(rho <= 0, F.lit(MAX_STRENGTH)).otherwise(F.greatest(F.lit(MIN_STRENGTH), F.least(F.lit(MAX_STRENGTH), k)))


def judge(pages: DataFrame, rules: dict[str, str], outcome: Column | None = None, url: str = "url", z: float = Z, threshold: float = THRESHOLD) -> DataFrame:
    """Adds host, path, rule, verdict and the posterior's mean and bound. outcome: 1 bad, 0 good, null
    unknown, of the page itself; unless given, what the rules say is the outcome."""
    pages = clear(pages, "host", "path", "rule", "verdict", "bad_mean", "bad_bound")
    own = pages.withColumn("host", host(F.col(url))).withColumn("path", path(F.col(url))).withColumn("rule", rule(F.col("host"), F.col("path"), rules))
    verdict = F.lit(None).cast("string")
    for r, v in rules.items():
        verdict = F.when(F.col("rule") == r, F.lit(v)).otherwise(verdict)
    seen = outcome if outcome is not None else F.when(verdict == "block", 1).when(verdict == "allow", 0)
    hosts = materialize(own.groupBy("host").agg(F.count("*").alias("pages"), F.count(seen).cast("double").alias("n"), F.coalesce(F.sum(seen), F.lit(0)).cast("double").alias("x")))
    hosts = hosts.withColumns({"domain": tail(F.col("host"), 1), "suffix": tail(F.col("host"), 0)})
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    total = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("n"), F.coalesce(F.sum("x"), F.lit(0.0)).alias("x")).first()
    mean = F.lit((total["x"] + 1) / (total["n"] + 2))  # four numbers come to the driver: this and a strength a level

    def shrink(children: DataFrame) -> tuple[DataFrame, float]:
        k = children.where(F.col("n") > 0).agg(strength(children).alias("k")).first()["k"]
        return children.withColumn("post", (F.col("x") + k * F.col("m")) / (F.col("n") + k)), k

    suffixes, _ = shrink(suffixes.withColumn("m", mean))
    domains, _ = shrink(domains.join(suffixes.select("suffix", F.col("post").alias("m")), "suffix"))
    hosts, k = shrink(hosts.join(domains.select("domain", F.col("post").alias("m")), "domain"))
    a, b = F.col("x") + k * F.col("m"), F.col("n") - F.col("x") + k * (1 - F.col("m"))
    deviation = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    reputation = materialize(hosts.select("host", "pages", F.col("post").alias("bad_mean"), (F.col("post") - z * deviation).alias("bad_bound")))
    return join_hot(own, reputation, ["host"], "pages").withColumn("verdict", F.coalesce(verdict, F.when(F.col("bad_bound") > threshold, "block").otherwise("allow")))
