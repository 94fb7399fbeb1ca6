"""URL filter by empirical-Bayes host reputation, with DataFrame functions only.

Pages with known outcomes are counted by host. Each level's rate is shrunk towards the level above
it, from host to registered domain to suffix to all pages, through beta priors whose strength is
estimated from the spread of the children's rates (beta-binomial moments). A host is blocked when
even the upper bound of its posterior rate is below a limit; explicit rules come before that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict)
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


# Some public suffixes of two labels, under which names are registered by different parties.
SUFFIXES = (
    "ac.in ac.jp ac.nz ac.uk ac.za asn.au co.id co.il co.in co.jp co.ke co.kr co.nz co.th co.uk co.za com.ar com.au com.br com.cn com.co "
    "com.eg com.hk com.mx com.my com.ng com.pe com.ph com.pk com.sa com.sg com.tr com.tw com.ua com.uy com.ve com.vn edu.au edu.br edu.cn "
    "edu.in edu.mx edu.tw firm.in gen.in go.jp go.kr gob.mx gov.au gov.br gov.cn gov.in gov.uk gov.za gr.jp id.au ind.in ltd.uk me.uk "
    "ne.jp net.au net.br net.cn net.in net.nz net.uk net.za nhs.uk or.jp or.kr org.au org.br org.cn org.in org.mx org.nz org.tw org.uk org.za "
    "plc.uk police.uk sch.uk web.za"
).split()
ADDRESS = r"^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*\])$"


def name_of(host: Column) -> Column:
    """A host without user and port."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")


def suffix(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The public suffix: the last two labels if they are listed, else the last; ``address`` for IP addresses."""
    name, two = name_of(host), F.substring_index(name_of(host), ".", -2)
    return F.when(name.rlike(ADDRESS), "address").when(two.isin(*suffixes), two).otherwise(F.substring_index(name, ".", -1))


def registered_domain(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The public suffix and one label before it, or all of a shorter name; an IP address is its own."""
    name, two = name_of(host), F.substring_index(name_of(host), ".", -2)
    return F.when(name.rlike(ADDRESS), name).when(two.isin(*suffixes), F.substring_index(name, ".", -3)).otherwise(two)


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(n, rule, verdict) of the longest rule that fits, or null.

    The rules are literals of the plan, keyed by their host; a host looks up itself and the domains above it.
    """
    by_host: dict[str, list] = {}
    for h, p, verdict in rules:
        by_host.setdefault(h.lower(), []).append((h + p, p, verdict))
    empty = F.array().cast("array<struct<n:int,rule:string,verdict:string,path:string>>")
    if not by_host:
        return F.lit(None).cast("struct<n:int,rule:string,verdict:string,path:string>")
    listed = lambda xs: F.array(*[F.struct(F.lit(len(r)).alias("n"), F.lit(r).alias("rule"), F.lit(v).alias("verdict"), F.lit(p).alias("path")) for r, p, v in xs])
    table = F.create_map(*[c for h, xs in sorted(by_host.items()) for c in (F.lit(h), listed(xs))])
    labels = F.split(host, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, n, F.size(labels)), "."))
    fit = F.filter(F.flatten(F.transform(above, lambda h: F.coalesce(F.element_at(table, h), empty))), lambda r: F.startswith(path, r["path"]))
    return F.when(host != "", F.array_max(fit))


def _moments() -> dict[str, Column]:
    """Sums over children with counts good of n. They are of integers or rounded, so the order of rows doesn't show."""
    g, m = F.col("good").cast("double"), F.col("n").cast("double")
    return {"g": F.sum("good"), "m": F.sum("n"), "k": F.count("*"), "gg": F.round(F.sum(g * g / m), 6), "mm": F.sum(m * m)}


def _prior(children: DataFrame, parent: str) -> DataFrame:
    """(parent, g, m, s): counts of each parent, and the strength of the prior that its children share."""
    sums = children.groupBy(parent).agg(*[c.alias(name) for name, c in _moments().items()])
    return sums.select(parent, "g", "m", strength(*[F.col(c) for c in ("g", "m", "k", "gg", "mm")]).alias("s"))


def strength(g: Column, m: Column, k: Column, gg: Column, mm: Column) -> Column:
    """Beta-binomial concentration s = (1 - rho) / rho, with rho estimated by moments, within 1 and 1000.

    Between-child sum of squares S = sum n_i (p_i - p)^2 has expectation
    p q (k - 1) (1 - rho) + p q rho (m - mm / m); one child or no spread gives the weakest evidence
    of difference, 1000.
    """
    p = g / m
    between = gg - g * p
    spread = p * (1 - p)
    rho = (between - spread * (k - 1)) / (spread * (m - mm / m - (k - 1)))
    bounded = F.when((k > 1) & (spread > 0) & (m - mm / m > k - 1), F.least(F.lit(0.5), F.greatest(F.lit(1 / 1001), rho))).otherwise(F.lit(1 / 1001))
    return (1 - bounded) / bounded


def reputations(outcomes: DataFrame, z: float = 1.645, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """(host, n, good, rate, low, high) for each host of rows (host, good int 0/1 or null): posterior mean and bounds.

    A null good says that the host is there, without an outcome. Hosts are pre-aggregated, so one
    with a third of all rows is one row after its partial sums. A domain's own counts update a
    prior centred at its suffix's rate, and a host's one centred at its domain's rate; a suffix is
    centred at the rate of all. A host whose domain has no outcome has the prior of its suffix's
    domains, or else that of all suffixes. No outcomes at all give no rows.
    """
    seen = outcomes.where("host <> ''").groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("good"))
    seen = seen.withColumns({"domain": registered_domain(F.col("host"), suffixes), "suffix": suffix(F.col("host"), suffixes)})
    hosts = seen.where("n > 0")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    tops = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))

    # The root's sums are over one row a suffix; then suffixes, their domains, and the domains' hosts.
    root = tops.agg(*[(F.round(F.sum(F.col("good").cast("double") * F.col("good") / F.col("n")), 6) if name == "gg" else c).alias(name) for name, c in _moments().items()])
    root = root.select((F.col("g") / F.col("m")).alias("rate"), strength(*[F.col(c) for c in ("g", "m", "k", "gg", "mm")]).alias("s"))
    mid = _prior(domains, "suffix").withColumnsRenamed({"g": "g_s", "m": "n_s", "s": "s_suffix"}).crossJoin(F.broadcast(root))
    mid = mid.select("suffix", "s_suffix", ((F.col("g_s") + F.col("s") * F.col("rate")) / (F.col("n_s") + F.col("s"))).alias("rate_s"))
    low = _prior(hosts, "domain").withColumnsRenamed({"s": "s_domain"}).withColumn("suffix", suffix(F.col("domain"), suffixes)).join(mid, "suffix")
    low = low.withColumn("rate_d", (F.col("g") + F.col("s_suffix") * F.col("rate_s")) / (F.col("m") + F.col("s_suffix")))
    all_ = seen.join(low.select("domain", "rate_d", "s_domain"), "domain", "left").join(mid, "suffix", "left").crossJoin(F.broadcast(root)).where("rate is not null")
    rate, s = F.coalesce("rate_d", "rate_s", "rate"), F.coalesce("s_domain", "s_suffix", "s")
    a = F.col("good") + s * rate
    total = F.col("n") + s
    mean = a / total
    sd = F.sqrt(mean * (1 - mean) / (total + 1))
    return all_.select("host", "n", "good", mean.alias("rate"), F.greatest(F.lit(0.0), mean - z * sd).alias("low"), F.least(F.lit(1.0), mean + z * sd).alias("high"))


def judged(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, limit: float = 0.5, z: float = 1.645, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages (page_id, url).

    outcomes are rows (page_id, good 0/1); a page they name several times counts as each says. A
    page's verdict is its longest rule's, else block if the posterior's upper bound for its host is
    below limit, else allow; a host without outcomes has the posterior of its domain, suffix or all
    pages. Registered domains are those below the listed public suffixes. An empty host is allowed, and every host if there is no outcome at all. A null page_id or
    url gives a row as well; an empty table gives none.
    """
    named = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = outcomes.select(F.col("page_id").alias("p"), F.col("good").cast("int").alias("good"))
    labelled = named.join(known, F.col("page_id") == F.col("p")).select("host", "good")
    everyone = labelled.union(named.select("host", F.lit(None).cast("int")))
    blocked = reputations(everyone, z, suffixes).where(F.col("high") < limit).select(F.concat("host", F.lit("")).alias("h"), F.lit(True).alias("blocked"))
    out = named.join(blocked, F.col("host") == F.col("h"), "left").withColumn("r", longest_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("blocked"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"))


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, good) from labels of documents: a page's document is the number in its path's second part."""
    doc = F.regexp_extract(path_of(F.col("url")), r"^/[^/]*/([0-9]{1,18})", 1)
    found = pages.select("page_id", F.when(doc != "", doc.cast("long")).alias("doc_id")).where("doc_id is not null")
    good = (F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(1)) == 0)
    return found.join(labels.select("doc_id", good.cast("int").alias("good")), "doc_id").select("page_id", "good")
