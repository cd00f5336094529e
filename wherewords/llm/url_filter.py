"""URL rules and host reputations by an empirical-Bayes hierarchy.

Labelled page outcomes are counted per host. A host's share of bad pages is shrunk
towards that of its registered domain, the domain's towards its suffix, the suffix's
towards all pages: each level's posterior mean is the mean of the beta prior one level
below, with a strength fitted to how much the children of a level differ. A host is
blocked if even the lower bound of its posterior is above the limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wherewords.llm.tables import table
from wherewords.session import small_table, stage

# Fixed values: (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
# A suffix is the last label, or two where registrars sell below a country's code.
SOLD_BELOW, COUNTRIES = ["ac", "co", "com", "gov", "net", "org"], ["au", "br", "cn", "in", "jp", "nz", "uk", "za"]
REGISTERED = rf"(?:([^.]*)\.)?((?:{'|'.join(SOLD_BELOW)})\.(?:{'|'.join(COUNTRIES)})|[^.]*)$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Hosts whose bad share is above the limit at this many deviations are blocked.
MAX_BAD, DEVIATIONS = 0.25, 1.645
#: Bounds of a prior's strength in pages, where the fit gives none.
WEAKEST, STRONGEST = 1.0, 10_000.0


def registered(host: Column) -> Column:
    """(domain, suffix) as :data:`REGISTERED` has them, by labels: the pattern would try a very
    long label from each of its letters on."""
    labels = F.split(host, r"\.", -1)
    third, second, last = (F.try_element_at(labels, F.lit(-n)) for n in (3, 2, 1))
    below = (F.size(labels) >= 3) & second.isin(SOLD_BELOW) & last.isin(COUNTRIES)
    suffix = F.when(below, F.concat_ws(".", second, last)).otherwise(last)
    front = F.when(below, third).otherwise(second)
    domain = F.when(F.size(labels) == 1, last).otherwise(F.concat(front, F.lit("."), suffix))
    return F.struct(domain.alias("domain"), suffix.alias("suffix"))


def host_of(url: Column) -> Column:
    """Lower-case host; empty for a null or a text without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), SPLIT, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), SPLIT, 2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as struct (rule, verdict); null if none fits."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, own_host, own_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(own_path)
        value = F.struct(F.lit(own_host + own_path).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value).otherwise(found)
    return found


def _strength(children: DataFrame) -> Column:
    """Moment estimate of a beta prior's strength out of the children (n, bad) of a level.

    With K children, N pages and the overall share p: the excess of the weighted squared
    deviations over the binomial's gives the correlation of pages within a child.
    """
    pages, share = F.sum("n"), F.sum("bad") / F.sum("n")
    # Σ n (bad/n - p)² without a second pass.
    squares = F.sum(F.col("bad") * F.col("bad") / F.col("n")) - share * F.sum("bad")
    spread = share * (1 - share)
    excess = squares - spread * (F.count("*") - 1)
    scale = spread * (pages - F.sum(F.col("n") * F.col("n")) / pages - (F.count("*") - 1))
    rho = excess / F.nullif(scale, F.lit(0.0))
    fitted = F.when(rho > 0, (1 - rho) / rho).otherwise(STRONGEST)
    return F.greatest(F.least(fitted, F.lit(STRONGEST)), F.lit(WEAKEST))


def host_reputation(outcomes: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(host, domain, suffix, n, bad, rate, lower) out of rows (host, bad 0/1), for the hosts of
    ``asked`` (host), or those of the outcomes.

    A host without outcomes has the posterior of its domain, else of its suffix, else of all.
    Null or empty hosts are a host of their own, the empty text; null outcomes do not
    count. Without any outcome the table has no rates.
    """
    parts = registered(F.col("host"))
    hosts = stage(
        outcomes.filter(F.col("bad").isNotNull())
        .groupBy(F.coalesce("host", F.lit("")).alias("host"))
        .agg(F.count("*").cast("double").alias("n"), F.sum("bad").cast("double").alias("bad"))
        .select("host", "n", "bad", parts.alias("p"))
        .select("host", "n", "bad", "p.domain", "p.suffix"),
        "hosts",
    )

    def level(*keys):
        return stage(hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "host-level")

    domains, suffixes = level("domain", "suffix"), level("suffix")
    # Four numbers: the share of all pages and the strength of each level's prior.
    strengths = [t.agg(_strength(t).alias("s")).first()["s"] for t in (suffixes, domains, hosts)]
    total = suffixes.agg((F.sum("bad") / F.sum("n")).alias("rate")).first()["rate"]
    over_suffix, over_domain, over_host = (F.lit(s if s is not None else STRONGEST) for s in strengths)

    def shrunk(mean: Column, strength: Column) -> Column:
        return (F.col("bad") + strength * mean) / (F.col("n") + strength)

    suffix_means = stage(suffixes.select("suffix", shrunk(F.lit(total), over_suffix).alias("suffix_mean")), "suffix-means")
    domain_means = stage(
        domains.join(suffix_means, "suffix").select("domain", shrunk(F.col("suffix_mean"), over_domain).alias("domain_mean")),
        "domain-means",
    )
    if asked is not None:
        every = asked.select(F.coalesce("host", F.lit("")).alias("host")).distinct().select("host", parts.alias("p"))
        counts = hosts.select("host", "n", "bad")
        zero = F.lit(0.0)
        hosts = every.join(counts, "host", "left").select(
            "host", F.coalesce("n", zero).alias("n"), F.coalesce("bad", zero).alias("bad"), "p.domain", "p.suffix"
        )
    mean = F.coalesce("domain_mean", "suffix_mean", F.lit(total))
    both = F.col("n") + over_host
    rate = (F.col("bad") + over_host * mean) / both
    return hosts.join(domain_means, "domain", "left").join(suffix_means, "suffix", "left").select(
        "host", "domain", "suffix", "n", "bad", rate.alias("rate"),
        (rate - DEVIATIONS * F.sqrt(rate * (1 - rate) / (both + 1))).alias("lower"),
    )


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: list[tuple[str, str, str]] = RULES,
    max_bad: float = MAX_BAD,
    key: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """One row per page: (key, host, path, rule, verdict, rate, lower).

    ``outcomes`` has (key, bad 0/1) for some pages; several outcomes of a page all count.
    A page that no rule fits is blocked if its host's lower bound is above ``max_bad``, that of a
    host without an outcome being its domain's, else its suffix's; without any outcome all are allowed. A null url has an empty host and path. Repeated
    rows are judged alike; other columns are left out; an empty table gives no rows.
    """
    parsed = pages.select(
        F.col(key).alias("page_key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")
    )
    seen = parsed.select("page_key", "host").join(
        outcomes.select(F.col(key).alias("page_key"), F.col("bad").cast("int").alias("bad")), "page_key"
    )
    # Staged, so that its true size decides how the pages meet it; a hot host is split.
    reputation = stage(host_reputation(seen, parsed).select("host", "rate", "lower"), "reputation")
    fitting = rule_of(F.col("host"), F.col("path"), rules)
    return (
        parsed.withColumn("fit", fitting)
        .join(reputation, "host", "left")
        .select(
            F.col("page_key").alias(key), "host", "path", F.col("fit.rule").alias("rule"),
            F.coalesce(
                "fit.verdict", F.when(F.col("lower") > max_bad, "block").otherwise("allow")
            ).alias("verdict"),
            "rate", "lower",
        )
    )


def op5_url_filter(spark, sf_dir):
    """Page outcomes: the labels of the document with the page's number; low quality or
    toxic counts as bad."""
    outcomes = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad")
    )
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), outcomes).select(
        "page_id", "host", "path", "rule", "verdict"
    )


def _sql_strength(level: str) -> str:
    return f"""(SELECT greatest(least(CASE WHEN excess / nullif(scale, 0) > 0
      THEN (1 - excess / scale) / (excess / scale) ELSE {STRONGEST} END, {STRONGEST}), {WEAKEST})
    FROM (SELECT share, sq - share * (1 - share) * (k - 1) AS excess,
        share * (1 - share) * (pages - n2 / pages - (k - 1)) AS scale
      FROM (SELECT sum(bad) / sum(n) AS share, sum(n) AS pages, count(*) AS k, sum(n * n) AS n2,
          sum(bad * bad / n) - sum(bad) / sum(n) * sum(bad) AS sq FROM {level})))"""


_FITS = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v} {h}{p}'"
    for v, h, p in sorted(RULES, key=lambda r: -len(r[1]) - len(r[2]))
)
SQL = f"""
WITH parsed AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{SPLIT}', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '{SPLIT}', 2) AS path FROM pages),
hosts AS (SELECT host, regexp_extract(host, '{REGISTERED}', 0) AS domain, regexp_extract(host, '{REGISTERED}', 2) AS suffix,
    CAST(count(*) AS DOUBLE) AS n, CAST(sum(CAST(quality = 0 OR toxic = 1 AS INTEGER)) AS DOUBLE) AS bad
  FROM parsed JOIN labels ON doc_id = page_id GROUP BY host),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
s AS (SELECT {_sql_strength("suffixes")} AS a, {_sql_strength("domains")} AS b, {_sql_strength("hosts")} AS c,
  (SELECT sum(bad) / sum(n) FROM hosts) AS m),
suffix_means AS (SELECT suffix, (bad + a * m) / (n + a) AS mean FROM suffixes, s),
domain_means AS (SELECT domain, (bad + b * mean) / (n + b) AS mean FROM domains JOIN suffix_means USING (suffix), s),
every AS (SELECT DISTINCT host, regexp_extract(host, '{REGISTERED}', 0) AS domain, regexp_extract(host, '{REGISTERED}', 2) AS suffix FROM parsed),
rates AS (SELECT e.host, (coalesce(h.bad, 0) + c * coalesce(d.mean, u.mean, m)) / (coalesce(h.n, 0) + c) AS rate, coalesce(h.n, 0) + c AS both_n
  FROM every e LEFT JOIN hosts h ON h.host = e.host LEFT JOIN domain_means d ON d.domain = e.domain LEFT JOIN suffix_means u ON u.suffix = e.suffix, s),
judged AS (SELECT p.*, CASE {_FITS} END AS fit,
    CASE WHEN rate - {DEVIATIONS} * sqrt(rate * (1 - rate) / (both_n + 1)) > {MAX_BAD} THEN 'block' ELSE 'allow' END AS own
  FROM parsed p LEFT JOIN rates USING (host))
SELECT page_id, host, path, split_part(fit, ' ', 2) AS rule, coalesce(split_part(fit, ' ', 1), own) AS verdict FROM judged"""
