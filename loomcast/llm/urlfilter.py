"""URL filter: explicit rules, then empirical-Bayes host reputation.

Outcomes (good or bad page) are counted per host and shrunk through three
beta-binomial levels: the corpus mean is the prior of each suffix, the suffix
of each registered domain, the domain of each host.  The strength of a level's
priors is estimated from the spread of its groups about their parents (moments
of the intra-class correlation), from the top down.  A host is blocked when even
the upper posterior bound of its share of good pages lies below ``min_good``;
hosts with little evidence stay near their domain.  A host without outcomes is
judged by the posterior of its domain, else of its suffix, else of the corpus,
with the bound of the prior that a new member has there.

Only column functions and joins are used.  Outcomes are counted before any
shuffle; the reputations are joined back on the host, where Spark splits hot
hosts.  Where no outcomes are given, weak ones are read off the pages: bad when
symbols outnumber a third of the words of the visible text or it has under 20.

Defined cases: a null url, or one without ``://``, has an empty host and path
and is judged by the reputation of the empty host; repeated rows are judged
each; no outcomes at all leave the prior mean of one half; a host of one label is
its own domain and suffix; very long urls are read whole; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcast.llm._shared import materialize, table

#: rule -> verdict.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: Two-label public suffixes (fixed values).
TWO_LABEL = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "org.au", "org.uk")
LEVELS = ("suffix", "domain", "host")


def split_url(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def groups_of(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host, without its port."""
    labels = F.split(F.regexp_replace(host, r":\d*$", ""), r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
    two = last(2).isin(*TWO_LABEL)
    return F.when(two, last(3)).otherwise(last(2)), F.when(two, last(2)).otherwise(last(1))


def rule_of(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict (nulls where none does)."""
    fits = []
    for rule, verdict in RULES.items():
        at = rule.index("/")
        name, prefix = rule[:at], rule[at:]
        ok = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        fits.append(F.when(ok, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    best = F.array_max(F.array(*fits))
    return best["rule"], best["verdict"]


def weak_outcomes(pages: DataFrame) -> DataFrame:
    """(url, good) read off each page."""
    text = F.regexp_replace(F.coalesce("html", F.lit("")), r"<[^>]*>", " ")
    symbols = F.char_length(text) - F.char_length(F.translate(text, "#*$%|<>", ""))
    words = F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+"))
    return pages.select("url", ((words >= 20) & (3 * symbols <= words)).cast("long").alias("good"))


def host_counts(outcomes: DataFrame) -> DataFrame:
    host, _ = split_url(F.col("url"))
    counts = outcomes.select(host.alias("host"), "good").groupBy("host").agg(F.sum("good").alias("good"), F.count(F.lit(1)).alias("n"))
    domain, suffix = groups_of(F.col("host"))
    return counts.select("host", domain.alias("domain"), suffix.alias("suffix"), "good", "n")


def _strength(groups: DataFrame) -> float:
    """Prior strength from the spread of groups (good, n) about their priors' means ``m`` (one row comes back).

    The share p of a group of n has variance m (1 - m) (1 + (n - 1) r) / n for
    an intra-class correlation r, and the strength is 1 / r - 1.
    """
    part = F.col("m") * (1 - F.col("m"))
    spread, inside, more = groups.agg(
        F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - F.col("m"), 2)), F.sum(part), F.sum(part * (F.col("n") - 1))
    ).head()
    if not more:
        return 10.0
    r = (spread - inside) / more
    return min(max(1 / r - 1, 1.0), 1000.0) if r > 0 else 1000.0


def reputations(counts: DataFrame, z: float = 1.645) -> dict[str, DataFrame]:
    """For each level, name -> posterior ``mean`` and ``upper`` bound of a host there; "corpus" is one row.

    At level "host" the bound is that of the host's own posterior, above it that
    of the prior a host without outcomes has.
    """
    counts = counts.select("host", "domain", "suffix", F.col("good").cast("double").alias("good"), F.col("n").cast("double").alias("n"))
    good, n = counts.agg(F.coalesce(F.sum("good"), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0.0))).head()
    corpus = (good + 1) / (n + 2)
    total = (F.sum("good").alias("good"), F.sum("n").alias("n"))
    post = lambda s: (F.col("good") + s * F.col("m")) / (F.col("n") + s)
    suffix = counts.groupBy("suffix").agg(*total).withColumn("m", F.lit(corpus))
    s = {"suffix": _strength(suffix)}
    suffix = suffix.select("suffix", post(s["suffix"]).alias("mean"))
    domain = counts.groupBy("suffix", "domain").agg(*total).join(suffix.withColumnRenamed("mean", "m"), "suffix")
    s["domain"] = _strength(domain)
    domain = domain.select("domain", post(s["domain"]).alias("mean"))
    host = counts.join(domain.withColumnRenamed("mean", "m"), "domain")
    s["host"] = _strength(host)
    bound = lambda size: (F.col("mean") + z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (size + 1))).alias("upper")
    host = host.select("host", post(s["host"]).alias("mean"), (F.col("n") + s["host"]).alias("size")).select("host", "mean", bound(F.col("size")))
    new = {"domain": s["host"], "suffix": min(s["host"], s["domain"]), "corpus": min(s.values())}
    top = counts.sparkSession.range(1).select(F.lit(corpus).alias("mean"))
    return {
        "host": host, "domain": domain.select("domain", "mean", bound(F.lit(new["domain"]))), "suffix": suffix.select("suffix", "mean", bound(F.lit(new["suffix"]))),
        "corpus": top.select("mean", bound(F.lit(new["corpus"]))),
    }


def filter_urls(pages: DataFrame, outcomes: DataFrame | None = None, id_col: str = "page_id", url: str = "url", min_good: float = 0.5) -> DataFrame:
    """Per row: ``page_id, host, path, rule, verdict, good_upper``."""
    if outcomes is None:
        outcomes = weak_outcomes(pages)
    counts, _ = materialize(host_counts(outcomes), "hosts")
    host, path = split_url(F.col("url"))
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url")).select(
        "page_id", host.alias("host"), path.alias("path")
    )
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    rows = rows.select("*", rule.alias("rule"), verdict.alias("by_rule"))
    level = reputations(counts)
    # each level once for the distinct hosts of the pages; the pages then meet one table
    domain, suffix = groups_of(F.col("host"))
    hosts = rows.select("host").distinct().select("host", domain.alias("domain"), suffix.alias("suffix"))
    for name in LEVELS:
        hosts = hosts.join(level[name].select(name, F.col("upper").alias(f"by_{name}")), name, "left")
    corpus = level["corpus"].head()
    judged = hosts.select("host", F.coalesce("by_host", "by_domain", "by_suffix", F.lit(corpus.upper)).alias("upper"))
    judged, _ = materialize(judged, "judged")
    out = rows.join(judged, "host", "left")
    by_host = F.when(F.col("upper") < min_good, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_host).alias("verdict"), F.col("upper").alias("good_upper"))


def query(spark, sf_dir):
    return filter_urls(table(spark, sf_dir, "pages")).drop("good_upper")


_STRENGTH = """
s_{level} AS (SELECT CASE WHEN coalesce(more, 0) = 0 THEN 10.0 WHEN spread > inside THEN least(greatest(more / (spread - inside) - 1, 1.0), 1000.0) ELSE 1000.0 END AS s
  FROM (SELECT sum(n * pow(good / n - m, 2)) AS spread, sum(m * (1 - m)) AS inside, sum(m * (1 - m) * (n - 1)) AS more FROM g_{level}))"""
_TWO = ", ".join(f"'{t}'" for t in TWO_LABEL)
_FITS = " ".join(
    f"UNION ALL SELECT page_id, rid, '{r}' AS rule, '{v}' AS verdict FROM u WHERE (host = '{r[: r.index('/')]}' OR suffix(host, '.{r[: r.index('/')]}')) AND prefix(path, '{r[r.index('/') :]}')"
    for r, v in RULES.items()
).removeprefix("UNION ALL ")
SQL = rf"""
WITH r AS (SELECT page_id, row_number() OVER () AS rid, html,
  CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, rid, translate(regexp_extract(rest, '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g') AS t FROM r),
o AS (SELECT host, CASE WHEN w >= 20 AND 3 * s <= w THEN 1 ELSE 0 END AS good FROM
  (SELECT host, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w, length(regexp_replace(t, '[^#*$%|<>]', '', 'g')) AS s FROM u)),
h AS (SELECT host, sum(good) AS good, count(*) AS n, string_split(regexp_replace(host, ':\d*$', ''), '.') AS l FROM o GROUP BY host),
k AS (SELECT *, array_to_string(l[-2:], '.') IN ({_TWO}) AS two FROM h),
c AS (SELECT host, CAST(good AS DOUBLE) AS good, CAST(n AS DOUBLE) AS n, array_to_string(CASE WHEN two THEN l[-3:] ELSE l[-2:] END, '.') AS domain,
  array_to_string(CASE WHEN two THEN l[-2:] ELSE l[-1:] END, '.') AS suffix FROM k),
mu AS (SELECT (coalesce(sum(good), 0) + 1) / (coalesce(sum(n), 0) + 2) AS mu FROM c),
g_suffix AS (SELECT suffix, sum(good) AS good, sum(n) AS n, any_value(mu) AS m FROM c, mu GROUP BY suffix),
{_STRENGTH.format(level="suffix")},
f AS (SELECT suffix, (good + s * m) / (n + s) AS m FROM g_suffix, s_suffix),
g_domain AS (SELECT domain, any_value(f.m) AS m, sum(good) AS good, sum(n) AS n FROM c JOIN f USING (suffix) GROUP BY suffix, domain),
{_STRENGTH.format(level="domain")},
d AS (SELECT domain, (good + s * m) / (n + s) AS m FROM g_domain, s_domain),
g_host AS (SELECT host, good, n, d.m AS m FROM c JOIN d USING (domain)),
{_STRENGTH.format(level="host")},
e AS (SELECT host, (good + s * m) / (n + s) AS p, n + s AS size FROM g_host, s_host),
b AS (SELECT host, p + 1.645 * sqrt(p * (1 - p) / (size + 1)) AS upper FROM e),
x AS ({_FITS}),
best AS (SELECT rid, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM x GROUP BY rid)
SELECT page_id, host, path, best.rule, coalesce(best.verdict, CASE WHEN upper < 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN best USING (rid) LEFT JOIN b USING (host)
"""
