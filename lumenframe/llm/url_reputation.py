"""URL filter: explicit rules first, then empirical-Bayes host reputation.

Labelled page outcomes (good or not) are counted per host, registered domain and
suffix. Each level's good share is shrunk to its parent's through a beta prior,
from the whole table down to suffix, domain and host; a level's prior strength is
estimated from how much its groups differ beyond binomial chance (a moment
estimate of their intraclass correlation). A url is allowed if the posterior mean
of its host less ``z`` posterior deviations reaches ``least``. A host without labels
has the share of its nearest labelled ancestor as mean, and the levels between them
widen its deviation.

All steps are DataFrame functions. Counts are summed before they are shuffled;
reputations have one row a host, and the join back lets adaptive skew handling
split a host that holds many pages.

The registered domain is the label before the suffix, with it. A suffix is the last
label of a host, or one of the listed ``suffixes`` of several labels; user names and
ports are left out, and an address is its own domain under the suffix ``ADDRESS``.

Defined results: a null url, or one without ``://``, has empty host and path, and
the host '' has a reputation like any other; a url of any length is read whole;
labels without a page are ignored; each label counts once for each host of its
page_id, however often the page is repeated; repeated rows are judged each; with no
labels all shares are ``base_share``; an empty table gives no rows; extra columns are
not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.decontamination import LOWER, UPPER


@dataclass(frozen=True)
class Rule:
    """``text`` is host/path-prefix; it fits the host and its subdomains."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.text.split("/", 1)[1]


@dataclass(frozen=True)
class Reputation:
    rules: tuple[Rule, ...] = (
        Rule("block", "com/en/"),
        Rule("allow", "example.com/en/7"),
        Rule("allow", "net/de/"),
        Rule("block", "example.net/de/8"),
        Rule("block", "org/es/"),
    )
    #: Public suffixes of several labels that are in wide use (publicsuffix.org
    #: has all of them; pass that list where it is at hand).
    suffixes: tuple[str, ...] = (
        "ac.jp", "ac.uk", "blogspot.com", "co.id", "co.il", "co.in", "co.jp", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.br",
        "com.cn", "com.co", "com.hk", "com.mx", "com.my", "com.pl", "com.sg", "com.tr", "com.tw", "com.ua", "com.vn", "edu.au", "github.io", "go.jp", "gov.uk",
        "ne.jp", "net.au", "or.jp", "org.au", "org.uk", "wordpress.com",
    )
    z: float = 1.645
    least: float = 0.75
    base_share: float = 0.5
    least_strength: float = 2.0
    most_strength: float = 200.0


AUTHORITY = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), AUTHORITY, 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), AUTHORITY, 2)


#: Suffix of hosts that are addresses.
ADDRESS = "address"


def name(host: Column) -> Column:
    """A host without user name and port."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


def is_address(name: Column) -> Column:
    return name.startswith("[") | name.rlike(r"^[0-9]+(\.[0-9]+){3}$")


def suffix(host: Column, how: Reputation = Reputation()) -> Column:
    own = name(host)
    two = F.substring_index(own, ".", -2)
    return F.when(is_address(own), ADDRESS).when(two.isin(list(how.suffixes)), two).otherwise(F.substring_index(own, ".", -1))


def domain(host: Column, how: Reputation = Reputation()) -> Column:
    """The label below the suffix, with it."""
    own = name(host)
    two = F.substring_index(own, ".", -2)
    return F.when(is_address(own), own).when(two.isin(list(how.suffixes)), F.substring_index(own, ".", -3)).otherwise(two)


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Struct ``rule, verdict`` of the longest fitting rule, or null.

    The list becomes one expression; it is meant for hand-written rules."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        chosen = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def strength(level: DataFrame, how: Reputation) -> DataFrame:
    """One row ``strength``: the prior strength of the level's groups ``n, good``."""
    sums = level.agg(
        F.sum("n").alias("N"), F.sum("good").alias("G"), F.count("*").alias("k"),
        F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.sum((F.col("good") * F.col("good") / F.col("n")).cast("decimal(28,10)")).cast("double").alias("gg"),
    )
    p = F.try_divide("G", "N")
    # Divisions give null where a level has one group or one outcome only.
    between = F.try_divide(F.col("gg") - F.col("G") * p, F.col("k") - 1)
    mean_size = F.try_divide(F.col("N") - F.try_divide("nn", "N"), F.col("k") - 1)
    excess = F.try_divide(F.try_divide(between, p * (1 - p)) - 1, mean_size - 1)
    usable = (F.col("k") > 1) & (p > 0) & (p < 1) & (mean_size > 1) & (excess > 0)
    found = F.when(usable, F.least(F.greatest(F.try_divide(F.lit(1.0), excess) - 1, F.lit(how.least_strength)), F.lit(how.most_strength))).otherwise(F.lit(how.most_strength))
    return sums.select(found.alias("strength"))


def shrunk(level: DataFrame, key: str, parent: str, prior: DataFrame, one: DataFrame) -> DataFrame:
    """``key, share, strength`` of the level's groups: their posterior share under
    the parent's share, and the prior strength used (of the one row ``one``).
    ``level``: key, parent, n, good."""
    joined = level.join(F.broadcast(one)).join(prior.select(F.col("key").alias(parent), F.col("share").alias("above")), parent)
    share = (F.col("good") + F.col("strength") * F.col("above")) / (F.col("n") + F.col("strength"))
    return joined.select(F.col(key).alias("key"), share.alias("share"), "strength", "above", "n", "good")


@dataclass(frozen=True)
class Levels:
    """Per level the shrunk groups, the one row of strengths, and the share of all."""

    suffixes: DataFrame
    domains: DataFrame
    hosts: DataFrame
    one: DataFrame


def levels(pages: DataFrame, labels: DataFrame, how: Reputation) -> Levels:
    outcomes = pages.select("page_id", host(F.col("url")).alias("host")).distinct().join(labels.select("page_id", "good").where("good is not null"), "page_id")
    hosts = outcomes.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("good"))
    hosts = hosts.withColumns({"domain": domain(F.col("host"), how), "suffix": suffix(F.col("host"), how)})
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("all", F.lit(1))
    whole = suffixes.groupBy("all").agg((F.sum("good") / F.sum("n")).alias("share")).select(F.col("all").alias("key"), "share")
    q_suffix, q_domain, q_host = (strength(x, how) for x in (suffixes, domains, hosts))
    by_suffix = shrunk(suffixes, "suffix", "all", whole, q_suffix)
    by_domain = shrunk(domains, "domain", "suffix", by_suffix, q_domain)
    by_host = shrunk(hosts, "host", "domain", by_domain, q_host)
    overall = whole.agg(F.coalesce(F.max("share"), F.lit(how.base_share)).alias("overall"))
    one = overall.join(q_suffix.toDF("q_suffix")).join(q_domain.toDF("q_domain")).join(q_host.toDF("q_host"))
    return Levels(by_suffix, by_domain, by_host, one)


def reputations(pages: DataFrame, labels: DataFrame, how: Reputation = Reputation()) -> DataFrame:
    """``host, posterior_mean, posterior_bound, n`` per labelled host. ``pages`` has
    page_id and url, ``labels`` page_id and good (0 or 1)."""
    return known(levels(pages, labels, how), how)


def known(of: Levels, how: Reputation) -> DataFrame:
    a = F.col("good") + F.col("strength") * F.col("above")
    b = F.col("n") - F.col("good") + F.col("strength") * (1 - F.col("above"))
    held = of.hosts.select(F.col("key").alias("host"), "n", a.alias("a"), b.alias("b"))
    return held.select("host", "n", mean("a", "b").alias("posterior_mean"), bound("a", "b", how.z).alias("posterior_bound"))


def inherited(hosts: DataFrame, of: Levels, how: Reputation) -> DataFrame:
    """``host, posterior_mean, posterior_bound`` of hosts without labels.

    Each unlabelled level below the ancestor varies about its parent with its own
    strength q. Variances add up, so that the host's beta has the strength whose
    q / (q + 1) is the product of theirs."""
    split = hosts.select("host", domain(F.col("host"), how).alias("domain"), suffix(F.col("host"), how).alias("suffix"))
    split = split.join(of.domains.select(F.col("key").alias("domain"), F.col("share").alias("by_domain")), "domain", "left")
    split = split.join(of.suffixes.select(F.col("key").alias("suffix"), F.col("share").alias("by_suffix")), "suffix", "left").join(F.broadcast(of.one))
    kept = lambda q: F.col(q) / (F.col(q) + 1)
    below_domain, below_suffix = kept("q_host"), kept("q_host") * kept("q_domain")
    stays = F.when(F.col("by_domain").isNotNull(), below_domain).when(F.col("by_suffix").isNotNull(), below_suffix).otherwise(below_suffix * kept("q_suffix"))
    share, q = F.coalesce("by_domain", "by_suffix", "overall"), stays / (1 - stays)
    held = split.select("host", (q * share).alias("a"), (q * (1 - share)).alias("b"))
    return held.select("host", mean("a", "b").alias("posterior_mean"), bound("a", "b", how.z).alias("posterior_bound"))


def mean(a: str, b: str) -> Column:
    return F.col(a) / (F.col(a) + F.col(b))


def bound(a: str, b: str, z: float) -> Column:
    total = F.col(a) + F.col(b)
    return F.col(a) / total - z * F.sqrt(F.col(a) * F.col(b) / (total * total * (total + 1)))


def judge_urls(pages: DataFrame, labels: DataFrame, how: Reputation = Reputation()) -> DataFrame:
    """``page_id, host, path, rule, verdict, posterior_bound`` per row of ``pages``.

    A host without labels is judged by the bound that it inherits."""
    url = F.col("url")
    own = pages.select("page_id", host(url).alias("host"), path(url).alias("path"))
    of = levels(pages, labels, how)
    labelled = known(of, how).select("host", "posterior_bound")
    others = own.select("host").distinct().join(labelled, "host", "left_anti")
    bounds = labelled.unionByName(inherited(others, of, how).select("host", "posterior_bound"))
    judged = own.join(bounds, "host", "left")
    chosen = longest_rule(F.col("host"), F.col("path"), how.rules)
    learned = F.when(F.col("posterior_bound") >= how.least, "allow").otherwise("block")
    return judged.select("page_id", "host", "path", chosen["rule"].alias("rule"), F.coalesce(chosen["verdict"], learned).alias("verdict"), "posterior_bound")
