"""URL filter by empirical-Bayes host reputation, in DataFrame functions only.

Pages with a known outcome (bad or not) are counted per host. Bad rates are
taken to be spread around the rate of the level above by a beta distribution:
suffixes around the overall rate, registered domains around their suffix, hosts
around their domain. How strongly they hold together is estimated from the
counts themselves, by moments of the beta-binomial distribution. From the top
down each level's rate is shrunk towards the one above, and a host gets a beta
posterior from its own pages and the prior of its domain. A host is blocked if
its bad rate exceeds LIMIT with a posterior probability of CONFIDENCE or more,
that is, if the lower posterior bound lies above LIMIT. Hosts without outcomes
have the posterior of their domain's prior.

Fixed rules come first: a rule names a host and the start of a path, holds for
the host and all its subdomains, and the longest one that fits decides.

Pages are counted per host and page before any shuffle by host. Only blocked
hosts are joined to the pages: broadcast after they have been counted, or else
in a join that adaptive execution splits at a hot host.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermoband.functions.special import beta_cdf
from thermoband.session import broadcast_if_small, durable

LIMIT, CONFIDENCE = 0.5, 0.95
#: Suffixes of more than one label under which domains are registered.
SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "net.au", "or.jp", "org.au", "org.uk")
#: The weight of a prior, in pages, is kept between these.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 10_000.0


class Rule(NamedTuple):
    """`allow` or `block`, and a host with the start of a path, like `example.net/en/`."""

    verdict: str
    where: str


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL; both empty without `://` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host, path = (F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", group) for group in (1, 2))
    return F.translate(host, ascii_uppercase, ascii_lowercase), path


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (where, verdict) of the longest rule that fits, the first of equally long ones, or null."""

    def fits(rule: Rule) -> Column:
        name, _, start = rule.where.partition("/")
        return ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}")

    longest = sorted(rules, key=lambda r: -len(r.where))
    told = [F.when(fits(r), F.struct(F.lit(r.where).alias("where"), F.lit(r.verdict).alias("verdict"))) for r in longest]
    return F.coalesce(*told, F.lit(None).cast("struct<where: string, verdict: string>"))


def levels(host: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and suffix of a host: its last labels, of which two are the suffix if they are in `suffixes`."""
    labels = F.split(host, r"\.")

    def last(n: int) -> Column:
        return F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")

    long = last(2).isin(*suffixes) if suffixes else F.lit(False)
    return F.when(long, last(3)).otherwise(last(2)), F.when(long, last(2)).otherwise(last(1))


def _weight(children: DataFrame) -> float:
    """The weight of the prior that `children` (n, bad, rate of the level above) are spread by.

    With a weight s the sum of n (share - rate)^2 is expected to be the sum of rate (1 - rate) (1 + (n - 1) / (s + 1)).
    """
    one = F.col("prior_rate") * (1 - F.col("prior_rate"))
    sums = children.where("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("prior_rate"), 2)).alias("spread"),
        F.sum(one).alias("alone"),
        F.sum(one * (F.col("n") - 1)).alias("together"),
    )
    spread, alone, together = sums.first()
    if not together:
        return LEAST_WEIGHT
    held = (spread - alone) / together
    return min(max(1 / held - 1, LEAST_WEIGHT), MOST_WEIGHT) if held > 0 else MOST_WEIGHT


def _shrunk(children: DataFrame) -> tuple[DataFrame, float]:
    """`children` (n, bad, prior_rate of the level above) with their own shrunk `rate`, and the weight of the prior."""
    known = durable(children)
    weight = _weight(known)
    return known.withColumn("rate", (F.col("bad") + F.col("prior_rate") * weight) / (F.col("n") + weight)), weight


def reputations(
    outcomes: DataFrame, limit: float = LIMIT, suffixes: Sequence[str] = SUFFIXES
) -> DataFrame:
    """A row per host of `outcomes` (host, n, bad: pages with an outcome and bad ones among them, any number of rows
    per host, n = 0 for hosts without): its domain, suffix, n, bad, the posterior's `a` and `b`, its mean `rate` and
    `beyond`, the posterior probability of a bad rate above `limit`.

    Rows with a null host or null counts are left out; an empty table gives no rows. Other columns are not read.
    """
    domain, suffix = levels(F.col("host"), suffixes)
    hosts = outcomes.where("host IS NOT NULL AND n IS NOT NULL AND bad IS NOT NULL").groupBy("host").agg(F.sum("n").cast("double").alias("n"), F.sum("bad").cast("double").alias("bad"))
    hosts = durable(hosts.withColumns({"domain": domain, "suffix": suffix}))
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    tops = domains.groupBy("suffix").agg(*sums)
    # Over everything: one page of either outcome beside those that are known.
    every = hosts.agg(((F.coalesce(F.sum("bad"), F.lit(0.0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0.0)) + 2)).alias("rate")).first().rate
    tops, _ = _shrunk(tops.withColumn("prior_rate", F.lit(every)))
    domains, _ = _shrunk(domains.join(tops.select("suffix", F.col("rate").alias("prior_rate")), "suffix"))
    hosts, weight = _shrunk(hosts.drop("suffix").join(domains.select("domain", F.col("rate").alias("prior_rate")), "domain"))
    a, b = F.col("bad") + F.col("prior_rate") * weight, F.col("n") - F.col("bad") + (1 - F.col("prior_rate")) * weight
    known = hosts.withColumns({"a": a, "b": b})
    return known.select("host", "domain", "n", "bad", "a", "b", "rate", (1 - beta_cdf(F.lit(limit), F.col("a"), F.col("b"))).alias("beyond"))


def judge(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule] = (), limit: float = LIMIT, confidence: float = CONFIDENCE,
    suffixes: Sequence[str] = SUFFIXES,
) -> DataFrame:
    """page_id, host, path, rule (where it fits, or null) and verdict (allow or block) of each row of `pages` (page_id, url).

    `outcomes` is what `reputations` takes. A null url, or one without `://`, has an empty host and path; the empty
    host is judged like any other. Repeated rows are judged alike. Other columns are not read; no pages give no rows.
    """
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    blocked = durable(reputations(outcomes, limit, suffixes).where(F.col("beyond") >= confidence).select("host"))
    known = parts.join(broadcast_if_small(blocked).withColumn("blocked", F.lit(True)), "host", "left")
    known = known.withColumn("fits", fitting_rule(F.col("host"), F.col("path"), rules))
    by_host = F.when(F.col("blocked"), "block").otherwise("allow")
    return known.select("page_id", "host", "path", F.col("fits.where").alias("rule"), F.coalesce("fits.verdict", by_host).alias("verdict"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, n, bad) of labelled pages: a page shows the document whose number is in its path, after the language,
    and is bad if that is labelled as of bad quality or toxic. Each document counts once per host."""
    host, path = url_parts(F.col("url"))
    number = F.regexp_extract(path, "^/[a-z]+/([0-9]+)", 1).try_cast("bigint")
    shown = pages.select(host.alias("host"), number.alias("doc_id")).distinct()
    bad = F.max((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int")
    marked = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(bad.alias("bad"))
    found = shown.join(marked, "doc_id", "left")
    return found.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
