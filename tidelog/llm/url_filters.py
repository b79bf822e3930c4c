"""URL filters (native): fixed allow and block rules first, then empirical-Bayes reputation of the host.

Labelled page outcomes (1 good, 0 bad) are counted per host, registered domain and suffix. Each level's good rate is
shrunk to its parent's by a beta-binomial prior, whose strength is fitted by moments over all children of the level:
suffix to the whole, domain to suffix, host to domain. A host's posterior is a beta distribution, and the host is allowed
while `least` is a lower bound of its good rate: while the posterior probability of a rate below `least` is at most
`alpha` (the regularised incomplete beta function, as a column expression).

For reputation a host is taken without user information and port, an IP address is its own domain and suffix, and a
registered domain is the last two labels, or three where the second last is a generic one (SECOND_LEVEL) under a
two-letter country code. This is a rule, not the full public suffix list.

Defined cases: a null url or one without :// has empty host and path and is judged as host '' (reputation of the
whole); ids may be null or repeat, every row is judged; without outcomes all hosts have the prior `start`; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import settled, stage, table

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Generic second-level labels under country codes.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "ltd", "me", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: len(r[1])):  # the outermost test is that of the longest rule
        name, slash, tail = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + tail)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def bare_host(host: Column) -> Column:
    """The host without user information, port and closing dot; an IPv6 address keeps its brackets."""
    name = F.substring_index(host, "@", -1)
    return F.when(name.startswith("["), F.regexp_extract(name, r"^\[[^\]]*\]?", 0)).otherwise(F.regexp_replace(F.substring_index(name, ":", 1), r"\.$", ""))


def registered_domain(host: Column, second_level: tuple[str, ...] = SECOND_LEVEL) -> Column:
    """Of a bare host: an IP address whole, else its last two labels, or three (see above)."""
    address = host.startswith("[") | host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    three = host.rlike(rf"(^|\.)({'|'.join(second_level)})\.[a-z]{{2}}$")
    return F.when(address, host).when(three, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def suffix_of(domain: Column) -> Column:
    """A domain without its first label; one label or an IP address is its own suffix."""
    address = domain.startswith("[") | domain.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    return F.when(address | (F.instr(domain, ".") == 0), domain).otherwise(F.substring(domain, F.instr(domain, ".") + 1, F.length(domain)))


def log_gamma(z: Column) -> Column:
    """Stirling's series at z + 8, shifted back; z > 0."""
    y = z + 8
    series = (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
    for i in range(8):
        series = series - F.ln(z + i)
    return series


def beta_below(a: Column, b: Column, x: float) -> Column:
    """Probability that a beta(a, b) variable is below x, by the continued fraction of the side where it converges."""
    turned = F.lit(x) > (a + 1) / (a + b + 2)
    p, q, at = F.when(turned, b).otherwise(a), F.when(turned, a).otherwise(b), F.when(turned, 1 - x).otherwise(x)
    terms = F.sequence(F.lit(1), (40 + 6 * F.sqrt(a + b)).cast("int"))

    def fraction(v: Column) -> Column:
        p, q, at = v["p"], v["q"], v["at"]

        def step(s: Column, i: Column) -> Column:
            m = i.cast("double")
            even, odd = m * (q - m) * at / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * at / ((p + 2 * m) * (p + 2 * m + 1))
            d1, c1 = 1 / (1 + even * s["d"]), 1 + even / s["c"]
            d2, c2 = 1 / (1 + odd * d1), 1 + odd / c1
            return F.struct(c2.alias("c"), d2.alias("d"), (s["h"] * d1 * c1 * d2 * c2).alias("h"))

        first = 1 / (1 - (p + q) * at / (p + 1))
        return F.aggregate(v["terms"], F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h")), step, lambda s: s["h"])

    bound = F.transform(F.array(F.struct(p.alias("p"), q.alias("q"), at.alias("at"), terms.alias("terms"))), fraction)[0]
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + p * F.ln(at) + q * F.ln(1 - at)) / p
    return F.when(turned, 1 - front * bound).otherwise(front * bound)


def host_reputation(hosts: DataFrame, least: float = 0.5, alpha: float = 0.05, start: tuple[float, float] = (0.8, 4.0), strength: tuple[float, float] = (2.0, 1000.0)) -> DataFrame:
    """From (host, n, k): labelled pages and good ones per bare host, to (host, mean, below, allowed)."""
    h = hosts.withColumn("domain", registered_domain(F.col("host"))).withColumn("suffix", suffix_of(F.col("domain")))
    h = stage(h, "hosts")
    total = lambda df, *keys: df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    d = total(h, "domain", "suffix")
    s = total(d, "suffix")
    whole = s.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).select(((F.coalesce("k", F.lit(0)) + start[0] * start[1]) / (F.coalesce("n", F.lit(0)) + start[1])).alias("p")).first()["p"]

    def fitted(df: DataFrame) -> float:
        """Prior strength m of a level by moments: E[(x - p)^2] = p q (1 + (n - 1) / (m + 1)) / n over children."""
        e = df.where("n > 1 and p0 > 0 and p0 < 1").select((F.pow(F.col("k") / F.col("n") - F.col("p0"), 2) * F.col("n") / (F.col("p0") * (1 - F.col("p0"))) - 1).alias("x"), (F.col("n") - 1).alias("w"))
        r = e.agg(F.sum("x").alias("x"), F.sum("w").alias("w")).first()
        if not r["w"]:
            return start[1]
        rho = min(1.0, max(1e-6, r["x"] / r["w"]))
        return min(strength[1], max(strength[0], 1 / rho - 1))

    shrunk = lambda m: (F.col("k") + m * F.col("p0")) / (F.col("n") + m)
    s = s.withColumn("p0", F.lit(whole))
    s = stage(s.withColumn("p", shrunk(fitted(s))).select("suffix", "p"), "suffixes")
    d = d.join(s.withColumnRenamed("p", "p0"), "suffix")
    d = stage(d.withColumn("p", shrunk(fitted(d))).select("domain", "p"), "domains")
    h = h.join(d.withColumnRenamed("p", "p0"), "domain")
    m = fitted(h)
    a, b = F.col("k") + m * F.col("p0"), F.col("n") - F.col("k") + m * (1 - F.col("p0"))
    got = h.select("host", (a / (a + b)).alias("mean"), beta_below(a, b, least).alias("below"))
    return got.withColumn("allowed", F.col("below") <= alpha)


@settled
def op4_url_filters(spark, sf_dir: str) -> DataFrame:
    host, path = url_parts(F.col("url"))
    pages = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path")).withColumn("bare", bare_host(F.col("host")))
    # a page shows the document whose id is the first number in its path; the document's label is the page's outcome
    shown = pages.groupBy("bare", F.regexp_extract("path", r"/(\d{1,18})(?:[/.]|$)", 1).try_cast("long").alias("doc_id")).agg(F.count("*").alias("pages"))
    labels = table(spark, sf_dir, "labels").where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("good"))
    hosts = shown.join(labels, "doc_id", "left").groupBy(F.col("bare").alias("host")).agg(
        F.sum(F.when(F.col("good").isNotNull(), F.col("pages")).otherwise(0)).alias("n"), F.sum(F.when(F.col("good") == 1, F.col("pages")).otherwise(0)).alias("k")
    )
    known = stage(host_reputation(hosts), "reputation").select(F.col("host").alias("host_"), "allowed")
    rule, verdict = matching_rule(F.col("host"), F.col("path"))
    got = pages.join(known, F.col("bare") == F.col("host_"), "left")
    return got.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("allowed"), "allow").otherwise("block")).alias("verdict"))
