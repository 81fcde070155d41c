"""URL filters: rules, and empirical-Bayes host reputation (DataFrame operations only).

Labelled outcomes of pages (bad or not) are counted by host. The rate of bad
pages of a host is beta-binomial: its prior comes from the registered domain,
whose prior comes from the suffix, whose prior comes from all pages. How
strongly a level's groups follow their parent is estimated from the counts
(method of moments). A host is blocked when the lower bound of its posterior
rate is over a limit, so hosts with little evidence pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm import _store


@dataclass(frozen=True)
class ReputationRules:
    #: (verdict, host, path prefix): fits the host and its subdomains.
    rules: tuple[tuple[str, str, str], ...] = (
        ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"),
    )
    #: Standard deviations from the posterior mean to its lower bound.
    z: float = 1.645
    limit: float = 0.5
    least_strength: float = 2.0
    most_strength: float = 1000.0


#: Second-level labels under which country domains register names (fixed values).
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "ne", "net", "or", "org")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null or where `://` is missing."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def by_list(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """host, domain, suffix of hosts (distinct) whose end is one of the listed public suffixes (a column of any name), by the longest; others are left out."""
    name = F.regexp_replace(F.regexp_replace("host", r"^.*@", ""), r":[0-9]*$", "")
    parts = hosts.select("host", F.split(name, r"\.").alias("_p")).withColumn("_k", F.explode(F.sequence(F.lit(1), F.size("_p"))))
    tails = parts.withColumn("_tail", F.array_join(F.slice("_p", F.size("_p") - F.col("_k") + 1, F.col("_k")), "."))
    listed = suffixes.select(F.lower(F.col(suffixes.columns[0])).alias("_tail")).where("_tail is not null").distinct()
    best = tails.join(listed, "_tail").groupBy("host").agg(F.max(F.struct("_k", "_tail", "_p")).alias("_b"))
    own = F.array_join(F.slice("_b._p", F.greatest(F.size("_b._p") - F.col("_b._k"), F.lit(1)), F.size("_b._p")), ".")
    return best.select("host", own.alias("domain"), F.col("_b._tail").alias("suffix"))


def levels(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host, without user part and port; an address in numbers is its own domain.

    Without a list of public suffixes the last label is the suffix, or the last
    two where a country's label follows one of SECOND_LEVEL.
    """
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    parts = F.split(name, r"\.")
    second = F.element_at(parts, -2)
    wide = (F.size(parts) >= 3) & (F.length(F.element_at(parts, -1)) == 2) & second.isin(*SECOND_LEVEL)
    count = F.when(wide, 2).otherwise(1)
    number = name.rlike(r"^[0-9.]+$")
    joined = lambda n: F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), F.size(parts)), ".")
    return F.when(number, name).otherwise(joined(count + 1)), F.when(number, F.lit("")).otherwise(joined(count))


def by_rule(host: Column, path: Column, rules: ReputationRules) -> tuple[Column, Column]:
    """The longest fitting rule (host and path as text) and its verdict, null where none fits."""
    text = verdict = F.lit(None).cast("string")
    for kind, name, prefix in sorted(rules.rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(prefix)
        text, verdict = F.when(fits, F.lit(name + prefix)).otherwise(text), F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def _strength(groups: DataFrame, rules: ReputationRules) -> tuple[float, float]:
    """Mean rate (with a uniform prior), and how many outcomes the parent's rate counts as: by the moments of groups (n, k), and no more than there are."""
    some = groups.where("n > 0")
    got = some.agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count("*").alias("groups"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk")).first()
    if not got["n"]:
        return 0.5, rules.least_strength
    n, p = float(got["n"]), got["k"] / got["n"]
    spread, free, noise = got["kk"] - n * p * p, n - got["nn"] / n, got["groups"] - 1.0
    below = p * (1 - p) * (free - noise)
    rho = (spread - p * (1 - p) * noise) / below if below > 0 else 0.0
    strength = 1 / rho - 1 if rho > 0 else rules.most_strength
    return (got["k"] + 1.0) / (n + 2.0), max(min(strength, rules.most_strength, n), rules.least_strength)


def host_reputation(
    pages: DataFrame, outcomes: DataFrame, url: str = "url", page: str = "page_id", rules: ReputationRules = ReputationRules(), suffixes: DataFrame | None = None
) -> DataFrame:
    """host, domain, suffix, n (labelled pages), k (bad ones), rate (posterior mean), bound (its lower bound), blocked: a row per host.

    outcomes has (page id, bad 0/1); several outcomes of a page count as bad if
    any is; null outcomes don't count. Pages without an outcome add their host
    with no evidence. Repeated rows of pages count each time. `suffixes` lists
    public suffixes (one column); without it, levels() tells domains by rule.
    The bound is the mean less z standard deviations of the beta posterior.
    """
    host, _ = split_url(F.col(url))
    labels = outcomes.toDF("_page", "_bad").where("_bad is not null").groupBy("_page").agg(F.max(F.col("_bad").cast("int")).alias("_bad"))
    seen = pages.select(F.col(page).alias("_page"), host.alias("host")).join(labels, "_page", "left")
    hosts = seen.groupBy("host").agg(F.count("_bad").alias("n"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("k"))
    domain, suffix = levels(F.col("host"))
    hosts = hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "k")
    if suffixes is not None:
        known = by_list(hosts.select("host"), suffixes).withColumnsRenamed({"domain": "_domain", "suffix": "_suffix"})
        hosts = hosts.join(known, "host", "left").select("host", F.coalesce("_domain", "domain").alias("domain"), F.coalesce("_suffix", "suffix").alias("suffix"), "n", "k")
    hosts = _store.stored(hosts, "hosts")  # read for the moments of each level
    total = lambda *by: hosts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    domains, suffixes = total("domain", "suffix"), total("suffix")
    mean, by_suffix = _strength(suffixes, rules)
    (_, by_domain), (_, by_host) = _strength(domains, rules), _strength(hosts, rules)
    post = lambda prior, m: (F.col("k") + m * prior) / (F.col("n") + m)
    suffixes = suffixes.select("suffix", post(F.lit(mean), by_suffix).alias("_suffix_rate"))
    domains = domains.join(suffixes, "suffix").select("domain", "suffix", post(F.col("_suffix_rate"), by_domain).alias("_domain_rate"))
    rated = hosts.join(domains, ["domain", "suffix"])
    rate, evidence = post(F.col("_domain_rate"), by_host), F.col("n") + by_host
    rated = rated.withColumn("rate", rate).withColumn("bound", F.col("rate") - rules.z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (evidence + 1)))
    return rated.select("host", "domain", "suffix", "n", "k", "rate", "bound", (F.col("bound") > rules.limit).alias("blocked"))


def filter_urls(
    pages: DataFrame, outcomes: DataFrame, url: str = "url", page: str = "page_id", rules: ReputationRules = ReputationRules(), suffixes: DataFrame | None = None
) -> DataFrame:
    """page_id, host, path, rule, verdict, reputation bound of every page.

    A fitting rule decides, the longest first; else the host's reputation. A
    null url, or one without `://`, has an empty host and path and is judged by
    the reputation of the empty host. One row out for each row in.
    """
    host, path = split_url(F.col(url))
    judged = pages.select(F.col(page).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = by_rule(F.col("host"), F.col("path"), rules)
    # written first, so that the join can deal out the pages of one large host to several tasks
    known = _store.stored(host_reputation(pages, outcomes, url, page, rules, suffixes).select("host", "bound", "blocked"), "reputation")
    return judged.join(known, "host").select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"), "bound",
    )


#: The same by another route: DuckDB SQL for the registered query (rules and parameters as in ReputationRules).
ORACLE = r"""
with split as (
  select page_id, coalesce(case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end, '') as rest from pages),
judged as (
  select page_id,
    translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from split),
outcome as (
  select doc_id, max(case when quality = 0 or toxic = 1 then 1 else 0 end) as bad from labels
  where quality is not null or toxic is not null group by doc_id),
hosts as (
  select host, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') as parts, count(bad) as n, coalesce(sum(bad), 0) as k
  from judged left join outcome on page_id = doc_id group by all),
named as (
  select host, n, k, array_to_string(parts[greatest(len(parts) - 1, 1):], '.') as domain, parts[-1] as suffix from hosts),
domains as (select domain, suffix, sum(n) as n, sum(k) as k from named group by all),
suffixes as (select suffix, sum(n) as n, sum(k) as k from named group by all),
moments as (
  select level, sum(n)::double as n, sum(k) / sum(n) as p, sum(k * k / n) - sum(n) * (sum(k) / sum(n)) * (sum(k) / sum(n)) as spread,
    sum(n) - sum(n * n) / sum(n) as free, count(*) - 1.0 as noise
  from (select 'host' as level, n, k::double as k from named union all select 'domain', n, k::double from domains union all select 'suffix', n, k::double from suffixes)
  where n > 0 group by level),
rho as (
  select level, n, p, case when p * (1 - p) * (free - noise) > 0 then (spread - p * (1 - p) * noise) / (p * (1 - p) * (free - noise)) else 0 end as rho from moments),
strength as (
  select level, (p * n + 1) / (n + 2) as p, greatest(least(case when rho > 0 then 1 / rho - 1 else 1000 end, 1000, n), 2)::double as m from rho),
suffix_rate as (
  select suffix, (k + m * p) / (n + m) as rate from suffixes, strength where level = 'suffix'),
domain_rate as (
  select d.domain, d.suffix, (d.k + m * s.rate) / (d.n + m) as rate from domains d join suffix_rate s using (suffix), strength where level = 'domain'),
host_rate as (
  select h.host, (h.k + m * d.rate) / (h.n + m) as rate, h.n + m as evidence from named h join domain_rate d using (domain, suffix), strength where level = 'host'),
fitting as (
  select *, host = 'com' or ends_with(host, '.com') as com, host = 'net' or ends_with(host, '.net') as net, host = 'org' or ends_with(host, '.org') as org,
    host = 'example.com' or ends_with(host, '.example.com') as ecom, host = 'example.net' or ends_with(host, '.example.net') as enet from judged),
ruled as (
  select page_id, host, path, case
    when ecom and starts_with(path, '/en/7') then 'example.com/en/7' when enet and starts_with(path, '/de/8') then 'example.net/de/8'
    when com and starts_with(path, '/en/') then 'com/en/' when net and starts_with(path, '/de/') then 'net/de/' when org and starts_with(path, '/es/') then 'org/es/' end as rule
  from fitting)
select page_id, host, path, rule, case
  when rule in ('example.com/en/7', 'net/de/') then 'allow' when rule is not null then 'block'
  when rate - 1.645 * sqrt(rate * (1 - rate) / (evidence + 1)) > 0.5 then 'block' else 'allow' end as verdict
from ruled join host_rate using (host)
"""
