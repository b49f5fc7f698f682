"""URL filter: written rules first, then the reputation of the host.

A host's *outcomes* are its labelled pages, good or bad.  Few hosts have many, so
its rate of bad pages is shrunk: hosts towards their registered domain, domains
towards their suffix, suffixes towards the whole.  At each level the children's
rates are taken as drawn from a beta distribution around the parent's posterior
mean, whose strength (how many pages the parent's opinion is worth) maximises the
beta-binomial likelihood of all children: empirical Bayes.  A page is blocked
when the posterior probability that its host's rate is above ``limit`` reaches
``confidence``, that is when the lower posterior bound is above the limit.

Shape of the job: outcomes fold to one row a host before and after the only wide
join (on the labelled id), likelihoods add up inside tasks to a row a strength, and
pages meet their host's row in an equi-join that adaptive execution can split for
a host that holds a third of all pages.  Only sums of fixed size reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Suffixes of more than one label under which names are registered; any other suffix is the last label.
SUFFIXES = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "co.nz", "com.br", "com.cn", "co.in", "co.kr", "com.mx", "com.tr", "co.za")
#: Strengths of a prior that are tried: half octaves.
STRENGTHS = tuple(2.0 ** (i / 2) for i in range(-2, 25))
#: Log-likelihoods nearer than this are equal; of equal strengths the largest, which trusts the parent most, is taken.
_EVEN = 1e-6

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for the pages of ``host`` and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without one."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def registered_domain(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The suffix and one label more; addresses and single labels are their own domain.

    User names, ports and closing dots don't belong to a name.
    """
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.*(:[0-9]*)?$", "")
    known = "|".join(s.replace(".", r"\.") for s in suffixes)
    found = F.regexp_extract(name, rf"(?:^|\.)([^.]+\.(?:{known + '|' if known else ''}[^.]+))$", 1)
    address = name.rlike(r"^[0-9]+(\.[0-9]+){3}$|\]$") | name.isin(*suffixes)
    return F.when(address | (found == ""), name).otherwise(found)


def suffix_of(domain: Column) -> Column:
    """What stands after a domain's first dot; addresses and single labels have none."""
    return F.when(domain.rlike(r"^[0-9]+(\.[0-9]+){3}$|\]$"), "").otherwise(F.regexp_extract(domain, r"^[^.]*\.(.*)$", 1))


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The fitting rule of most characters (of equal ones, of the longer host) as ``struct(rule, verdict)``, or null."""
    ordered = sorted(rules, key=lambda r: (-len(r.host + r.path), -len(r.host), r.host, r.path, r.verdict))
    fits = lambda r: ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
    options = [F.when(fits(r), F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in ordered]
    return F.coalesce(*options) if options else F.lit(None).cast("struct<rule:string,verdict:string>")


def count_outcomes(pages: DataFrame, outcomes: DataFrame, key: Column, url_col: str = "url") -> DataFrame:
    """One row per host of ``pages``: ``host``, ``n`` labelled pages, ``bad`` ones.

    ``outcomes`` has ``key`` (long) and ``bad`` (0/1); ``key`` is an expression over
    ``pages`` for the outcome a page belongs to, null for none.  An outcome given
    twice is bad if either says so; null keys and null outcomes are none.
    """
    known = outcomes.filter(F.col("key").isNotNull() & F.col("bad").isNotNull()).groupBy("key").agg(F.max(F.col("bad").cast("long")).alias("bad"))
    seen = pages.select(url_host(F.coalesce(F.col(url_col), F.lit(""))).alias("host"), key.cast("long").alias("key")).groupBy("host", "key").agg(F.count("*").alias("pages"))
    met = seen.join(known, "key", "left")
    counted = F.when(F.col("bad").isNotNull(), F.col("pages"))
    return met.groupBy("host").agg(F.coalesce(F.sum(counted), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("pages") * F.col("bad")), F.lit(0)).alias("bad"))


def log_likelihood(bad: int, n: int, mean: float, strength: float) -> float:
    """Of ``bad`` in ``n`` under a beta prior, without the binomial coefficient, which no strength changes."""
    a, b, g = mean * strength, (1 - mean) * strength, math.lgamma
    return g(bad + a) - g(a) + g(n - bad + b) - g(b) + g(strength) - g(n + strength)


def _likelihoods(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = [0.0] * len(STRENGTHS)
    for batch in part:
        for bad, n, mean in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            for i, strength in enumerate(STRENGTHS):
                sums[i] += log_likelihood(bad, n, mean, strength)
    yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array(sums, pa.float64())], names=["at", "total"])


def fit_strength(children: DataFrame) -> float:
    """The strength under which the children's ``bad`` of ``n`` around ``mean`` are likeliest.

    Children with one outcome or none say nothing about it and are passed over;
    without any others the largest strength is taken.
    """
    several = children.filter("n > 1").select("bad", "n", "mean")
    sums = several.mapInArrow(_likelihoods, "at int, total double").groupBy("at").agg(F.sum("total").alias("total")).collect()
    best = max((r["total"] for r in sums), default=0.0)
    return STRENGTHS[max((r["at"] for r in sums if r["total"] >= best - _EVEN), default=len(STRENGTHS) - 1)]


def tail(a: float, b: float, limit: float) -> float:
    """P(X > ``limit``) for X of a beta distribution: the regularised incomplete beta function as a continued fraction."""
    if limit <= 0:
        return 1.0
    if limit >= 1:
        return 0.0
    x, turned = limit, limit > (a + 1) / (a + b + 2)
    if turned:
        a, b, x = b, a, 1 - x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # Terms from the last back to the first; so many are enough for counts of any size that matters.
    steps, value = int(60 + 6 * math.sqrt(a + b)), 1.0
    for m in range(steps, 0, -1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m - 1) * (a + b + m - 1) * x / ((a + 2 * m - 2) * (a + 2 * m - 1))
        value = 1 + odd / (1 + even / value)
    below = front / value
    return min(1.0, max(0.0, below if turned else 1 - below))


def _tails(limit: float):
    def work(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in part:
            *kept, a, b = batch.columns
            tails = [tail(x, y, limit) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)]
            rates = [x / (x + y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(rates, pa.float64()), pa.array(tails, pa.float64())], names=["host", "domain", "suffix", "n", "bad", "rate", "above"])

    return work


def shrunk(strength: float) -> Column:
    """Posterior mean of a row's ``bad`` of ``n`` around ``mean``."""
    return (F.col("bad") + strength * F.col("mean")) / (F.col("n") + strength)


def reputations(counts: DataFrame, limit: float | None = None, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """``counts`` (host, n, bad) with ``domain``, ``suffix``, ``rate`` (posterior mean) and ``above`` (probability that the rate is above ``limit``).

    ``limit`` is the rate over all outcomes where none is given.  Hosts without
    outcomes have their domain's rate.  Without any outcome the rate is a half
    and nothing is above.  ``counts`` is read several times: hand over a written
    table.
    """
    named = counts.withColumn("domain", registered_domain(F.col("host"), suffixes)).withColumn("suffix", suffix_of(F.col("domain")))
    n, bad = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    whole = (bad + 0.5) / (n + 1)
    domains = named.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    ends = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("mean", F.lit(whole))
    ends = ends.select("suffix", shrunk(fit_strength(ends)).alias("mean"))
    domains = domains.join(ends, "suffix")
    domains = domains.select("domain", shrunk(fit_strength(domains)).alias("mean"))
    hosts = named.join(domains, "domain")
    strength = fit_strength(hosts)
    shapes = hosts.select("host", "domain", "suffix", "n", "bad", (F.col("bad") + strength * F.col("mean")).alias("a"), (F.col("n") - F.col("bad") + strength * (1 - F.col("mean"))).alias("b"))
    at = (whole if limit is None else limit) if n else 1.0
    return shapes.mapInArrow(_tails(at), "host string, domain string, suffix string, n long, bad long, rate double, above double")


def judge(pages: DataFrame, counts: DataFrame, rules: tuple[Rule, ...] = (), confidence: float = 0.95, limit: float | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """A verdict on each page: id, ``host``, ``path``, ``rule``, ``verdict``, ``domain``, ``suffix``, ``n_labelled``, ``n_bad``, ``rate``, ``above``.

    A fitting rule decides; else a page is blocked if its host's rate is above
    ``limit`` with a posterior probability of ``confidence`` or more.  Null urls and
    urls without ``://`` have an empty host and path, and are judged as that host.
    Ids may be null or repeat, other columns aren't read, and an empty table gives
    no rows.  ``counts`` must know every host (``count_outcomes`` of these pages).
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    found = pages.select(F.col(id_col).cast("long").alias("row_id"), url_host(url).alias("host"), url_path(url).alias("path"))
    found = found.withColumn("ruled", longest_rule(F.col("host"), F.col("path"), rules))
    known = reputations(counts, limit).withColumn("own", F.when(F.col("above") >= confidence, "block").otherwise("allow"))
    return found.join(known, "host").select(
        F.col("row_id").alias(id_col),
        "host",
        "path",
        F.col("ruled.rule").alias("rule"),
        F.coalesce("ruled.verdict", "own").alias("verdict"),
        "domain",
        "suffix",
        F.col("n").alias("n_labelled"),
        F.col("bad").alias("n_bad"),
        F.round("rate", 6).alias("rate"),
        F.round("above", 6).alias("above"),
    )


def filter_pages(pages: DataFrame, labels: DataFrame, rules: tuple[Rule, ...], confidence: float = 0.95) -> DataFrame:
    """``judge`` with the outcomes of documents: a page's url names its document after the language (``/en/17``).

    A document is bad if its quality is 0 or it is toxic, and unlabelled where both are null.
    """
    bad = F.when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), ((F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)).cast("int"))
    outcomes = labels.select(F.col("doc_id").cast("long").alias("key"), bad.alias("bad"))
    path = url_path(F.coalesce(F.col("url"), F.lit("")))
    key = F.expr("try_cast(nullif(named, '') AS BIGINT)")
    held = pages.select("page_id", "url", F.regexp_extract(path, r"^/[a-z]+/([0-9]{1,18})(?:[/.]|$)", 1).alias("named"))
    counts = materialise(count_outcomes(held, outcomes, key), "url-outcomes")
    return judge(held, counts, rules, confidence)
