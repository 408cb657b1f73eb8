"""URL filter by empirical-Bayes host reputation, with explicit rules on top.

Labelled page outcomes (1 is bad) are counted per host, registered domain and suffix.  The bad share of a
group is a beta posterior whose prior has its parent's posterior mean and a strength estimated from how much
the groups of that level differ; hosts without labels take their domain's, and so on up to all pages.
A page is blocked when even the lower posterior bound of its host's bad share passes ``ratio`` times the bad share of all
pages: the host is surely worse than the pages at large, whatever their level.  Hosts that don't differ are all allowed.

Rules are ``host/path`` prefixes: one fits its host and all subdomains if the page's path starts with its
path, and the longest wins over the method.

Defined cases: a null url, or one without ``://``, has empty host and path, which no rule fits, and counts as a host of
its own; without labelled rows the bad share is the prior's 1/2 with strength 2 and nothing is blocked by the method; of a page with
several outcomes the worst counts; repeated rows are judged alike, and a labelled one counts as often as it stands there; labels of
unknown pages count nowhere; of fitting rules of equal length the one last in order of text wins; hosts of digits and dots are their own
domain; very long urls are matched like others; extra columns are not read.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.plans.lineage import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Suffixes of two labels under which names are registered.
SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "net.uk", "org.uk", "plc.uk", "sch.uk", "com.au", "edu.au", "gov.au", "net.au", "org.au", "co.jp", "ac.jp", "go.jp", "ne.jp", "or.jp", "co.nz", "net.nz", "org.nz",
    "co.za", "org.za", "com.br", "net.br", "org.br", "com.cn", "net.cn", "org.cn", "com.tr", "com.mx", "com.ar", "com.tw", "com.hk", "com.sg", "co.in", "net.in", "org.in", "co.kr", "or.kr", "co.il", "com.ua", "com.pl",
)
#: Prior pseudo-counts of the root, and the limits of an estimated strength.
ROOT = (1.0, 1.0)
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1_000.0
Z = 1.645
SALTS = 16


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    """The last label, or the last two where names are registered below those; an address has none."""
    two = F.substring_index(host, ".", -2)
    return F.when(host.rlike(r"^[0-9.]+$"), "").when(two.isin(*SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and one label more; an address itself."""
    two = F.substring_index(host, ".", -2)
    return F.when(host.rlike(r"^[0-9.]+$"), host).when(two.isin(*SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def _shrunk(groups: DataFrame, parents: DataFrame, key: str, parent: str) -> DataFrame:
    """Posterior ``a, b`` of ``groups(key, parent, n, bad)`` under ``parents(parent, a, b)``.

    Strength by moments: with m pages a group, the variance of shares around the parents' means is
    ``mean * (1 - mean) * (1 + (m - 1) * rho) / m``, and the strength is ``1 / rho - 1``.
    """
    with_mean = groups.join(parents.select(parent, (F.col("a") / (F.col("a") + F.col("b"))).alias("mu")), parent)
    n, mu = F.col("n"), F.col("mu")
    moments = with_mean.filter("n > 1").agg(
        F.sum(n * (F.col("bad") / n - mu) ** 2 - mu * (1 - mu)).alias("over"), F.sum((n - 1) * mu * (1 - mu)).alias("room")
    )
    rho = F.greatest(F.lit(1e-6), F.least(F.lit(1.0), F.col("over") / F.col("room")))
    strength = moments.select(F.coalesce(F.greatest(F.lit(LEAST_STRENGTH), F.least(F.lit(MOST_STRENGTH), 1 / rho - 1)), F.lit(MOST_STRENGTH)).alias("k"))
    out = with_mean.withColumn("k", F.lit(strength.head()[0]))  # one number
    return cut(out.select(key, (F.col("k") * mu + F.col("bad")).alias("a"), (F.col("k") * (1 - mu) + n - F.col("bad")).alias("b")))


def reputation(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``(host, n, bad, a, b, mean, lower, upper, base)`` for every host of ``pages(page_id, host)``; ``outcomes(page_id, bad)``.

    ``base`` is the bad share of all pages.  Counts are partial aggregates, so one host with a third of the pages is combined before its shuffle.
    They and each level's posteriors are written, so no level counts the pages again.
    """
    one = outcomes.filter("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("bad"))
    hosts = cut(
        pages.select("page_id", "host")
        .join(one, "page_id", "left")
        .groupBy("host")
        .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
        .withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host")), "top": F.lit(0)})
    )

    def rolled(key: str, *up: str) -> DataFrame:
        return hosts.groupBy(key, *up).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))

    root = hosts.groupBy("top").agg((F.lit(ROOT[0]) + F.sum("bad")).alias("a"), (F.lit(ROOT[1]) + F.sum("n") - F.sum("bad")).alias("b"))
    base = (root.select(F.col("a") / (F.col("a") + F.col("b"))).head() or (0.5,))[0]  # one number
    suffixes = _shrunk(rolled("suffix", "top"), root, "suffix", "top")
    domains = _shrunk(rolled("domain", "suffix"), suffixes, "domain", "suffix")
    judged = _shrunk(hosts.select("host", "domain", "n", "bad"), domains, "host", "domain")
    a, b = F.col("a"), F.col("b")
    mean = a / (a + b)
    spread = Z * F.sqrt(mean * (1 - mean) / (a + b + 1))
    return hosts.select("host", "n", "bad").join(judged, "host").select("*", mean.alias("mean"), F.greatest(F.lit(0.0), mean - spread).alias("lower"), F.least(F.lit(1.0), mean + spread).alias("upper"), F.lit(base).alias("base"))


def ruled(pages: DataFrame, rules: tuple[tuple[str, str], ...]) -> DataFrame:
    """``pages(host, path, ...)`` with ``rule`` and ``rule_verdict`` of the longest fitting rule, else null.

    The host's own suffixes are looked up in a map of the rules, so a page costs as many look-ups as its host
    has labels, and nothing is joined or exploded.
    """
    by_host: dict[str, list[tuple[str, str]]] = {}
    for verdict, rule in rules:
        by_host.setdefault(rule.partition("/")[0].lower(), []).append((verdict, rule))
    none = F.lit(None).cast("array<struct<rule: string, path: string, verdict: string>>")
    entries = []
    for host, own in by_host.items():
        entries += [F.lit(host), F.array(*[F.struct(F.lit(r).alias("rule"), F.lit("/" + r.partition("/")[2]).alias("path"), F.lit(v).alias("verdict")) for v, r in own])]
    table = F.create_map(*entries) if entries else F.lit(None).cast("map<string, array<struct<rule: string, path: string, verdict: string>>>")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    mine = F.flatten(F.filter(F.transform(suffixes, lambda s: F.coalesce(F.try_element_at(table, s), none)), lambda x: x.isNotNull()))
    fitting = F.filter(mine, lambda r: F.col("path").startswith(r["path"]))
    best = F.array_max(F.transform(fitting, lambda r: F.struct(F.length(r["rule"]).alias("size"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return pages.withColumn("_best", best).select("*", F.col("_best.rule").alias("rule"), F.col("_best.verdict").alias("rule_verdict")).drop("_best")


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, ratio: float = 1.0) -> DataFrame:
    """``(page_id, host, path, rule, verdict, mean, lower)`` of ``pages(page_id, url)``."""
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = reputation(split, outcomes).select("host", "mean", "lower", "base")
    method = F.when(F.col("lower") > ratio * F.col("base"), "block").otherwise("allow")
    # a host may hold a third of all pages: its rows are dealt over ``SALTS`` parts, each of which has the host's row
    dealt = ruled(split, rules).withColumn("_salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int"))
    known = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(known, ["host", "_salt"]).select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", method).alias("verdict"), "mean", "lower")

