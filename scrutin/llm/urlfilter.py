"""URL filters: rules, and empirical-Bayes reputation of hosts.

Labelled page outcomes are counted per host and summed to registered domains
and suffixes. A suffix's share of good pages is shrunk to the overall share, a
domain's to its suffix's, a host's to its domain's, by beta-binomial priors
whose strength at each level is fitted by moments: groups that scatter no more
than chance would are pulled close to their parent, others keep their own
share. A page is blocked if even the upper bound of its host's posterior share
of good pages is below ``GOOD``. A rule that fits the url overrides that.

Edge cases: a null url, or one without ``://``, has empty host and path, fits
no rule, and is judged by the overall share; hosts without labelled pages get
their domain's, suffix's or the overall posterior; without any labels
everything is allowed; repeated rows are judged alike; an empty table stays
empty; added columns replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, without, written

#: (verdict, host, path): a rule fits its host and all subdomains where the url's path starts with its path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Share of good pages that a host's upper bound must reach; standard deviations of the bound.
GOOD, BOUND = 0.5, 2.0
#: Weakest and strongest prior, in pages.
LEAST, MOST = 2.0, 1000.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: str) -> Column:
    found = F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), _UPPER, _LOWER)


def path(url: str) -> Column:
    return F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def domain(name: str) -> Column:
    """Registered domain: the last two labels of a host."""
    return F.substring_index(F.col(name), ".", -2)


def suffix(name: str) -> Column:
    return F.substring_index(F.col(name), ".", -1)


def rule_of(host_col: Column, path_col: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict (both null if none does)."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host_col == h) | host_col.endswith(f".{h}")) & path_col.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _strength(groups: DataFrame) -> float:
    """Prior strength of ``(n, good, parent)`` rows by the method of moments:
    the scatter of the shares beyond the binomial's gives the correlation of
    pages of a group, and that the strength."""
    p = F.col("parent")
    row = groups.agg(
        F.sum(F.pow(F.col("good") - F.col("n") * p, 2)).alias("scatter"),
        F.sum(F.col("n") * p * (1 - p)).alias("chance"),
        F.sum(F.col("n") * (F.col("n") - 1) * p * (1 - p)).alias("pairs")).first()
    if not row["pairs"] or row["pairs"] <= 0:
        return MOST
    rho = (row["scatter"] - row["chance"]) / row["pairs"]
    return MOST if rho <= 1 / (1 + MOST) else max(LEAST, 1 / rho - 1)


def reputations(outcomes: DataFrame) -> tuple[float | None, DataFrame, DataFrame, DataFrame]:
    """From ``outcomes(host, good 0/1)``: the overall share of good pages, and
    the posterior ``(name, a, b)`` of suffixes, domains and hosts."""
    hosts = written(outcomes.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"))
                    .withColumn("domain", domain("host")).withColumn("suffix", suffix("host")))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    overall = (total["good"] + 1) / (total["n"] + 2) if total["n"] else None
    prior, out = None, []
    for level, above in (("suffix", None), ("domain", "suffix"), ("host", "domain")):
        keys = ["suffix", "domain", "host"][:["suffix", "domain", "host"].index(level) + 1]
        rows = hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
        if above is None:
            rows = rows.withColumn("parent", F.lit(overall if overall is not None else 0.5))
        else:
            rows = rows.join(prior.select(*keys[:-1], (F.col("a") / (F.col("a") + F.col("b"))).alias("parent")), keys[:-1])
        rows = written(rows)
        k = _strength(rows)
        prior = rows.select(*keys, (F.col("parent") * k + F.col("good")).alias("a"),
                            ((1 - F.col("parent")) * k + F.col("n") - F.col("good")).alias("b"))
        out.append(prior)
    return overall, *out


def _bound(a: Column, b: Column) -> Column:
    """Upper bound of the share of good pages of a beta posterior."""
    mean = a / (a + b)
    return mean + BOUND * F.sqrt(mean * (1 - mean) / (a + b + 1))


def judge(pages: DataFrame, outcomes: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``bound`` (upper bound of
    the host's share of good pages) and ``verdict``. ``outcomes(url, good)``
    are labelled pages."""
    seen = outcomes.select(host("url").alias("host"), F.col("good").cast("long").alias("good")).filter("good is not null")
    overall, by_suffix, by_domain, by_host = reputations(seen)
    base = without(pages.withColumn("__url", F.col(url)), "host", "path", "rule", "bound", "verdict")
    base = base.withColumn("host", host("__url")).withColumn("path", path("__url")).drop("__url")
    # one row per host: its own posterior, or that of the nearest level above
    names = written(base.select("host").distinct().withColumn("domain", domain("host")).withColumn("suffix", suffix("host")))
    for level, post in (("host", by_host), ("domain", by_domain), ("suffix", by_suffix)):
        names = names.join(post.select(level, _bound(F.col("a"), F.col("b")).alias(f"__{level}")), level, "left")
    names = written(names.select("host", F.coalesce("__host", "__domain", "__suffix", F.lit(
        overall if overall is not None else 1.0)).alias("bound")))
    # both sides come from files, so AQE may split the pages of one common host
    out = base.join(names, "host", "left")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return out.withColumn("rule", rule).withColumn("verdict", F.coalesce(
        verdict, F.when(F.col("bound") < GOOD, "block").otherwise("allow")))


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``(url, good)``: a page's outcome is the quality label of the document
    whose number its path ends in."""
    number = F.regexp_extract("url", r"^[^?#]*/(\d+)(?:/|\.html)?(?:[?#].*)?$", 1)
    numbered = pages.select("url", number.alias("n")).select("url", F.expr("try_cast(n as bigint)").alias("doc_id"))
    good = labels.filter("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("good"))
    return numbered.join(good, "doc_id").select("url", "good")


def op8_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    outcomes = labelled_pages(pages, table(spark, sf_dir, "labels"))
    return judge(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


_LEVEL = """
{name}_g AS (SELECT {keys}, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY {keys}),
{name}_p AS (SELECT g.*, {parent} AS parent FROM {name}_g g {join}),
{name}_m AS (SELECT sum(power(good - n * parent, 2)) AS scatter, sum(n * parent * (1 - parent)) AS chance,
    sum(n * (n - 1) * parent * (1 - parent)) AS pairs FROM {name}_p),
{name}_k AS (SELECT CASE WHEN pairs IS NULL OR pairs <= 0 THEN 1000.0
    WHEN (scatter - chance) / pairs <= 1 / 1001.0 THEN 1000.0
    ELSE greatest(2.0, 1 / ((scatter - chance) / pairs) - 1) END AS k FROM {name}_m),
{name}_b AS (SELECT {keys}, parent * k + good AS a, (1 - parent) * k + n - good AS b FROM {name}_p, {name}_k)"""


def _level(name: str, keys: str, above: str | None) -> str:
    if above is None:
        return _LEVEL.format(name=name, keys=keys, parent="overall.p", join="CROSS JOIN overall")
    return _LEVEL.format(name=name, keys=keys, parent="u.a / (u.a + u.b)", join=f"JOIN {above}_b u USING ({above})")


_UP = "x.a / (x.a + x.b) + 2 * sqrt((x.a / (x.a + x.b)) * (1 - x.a / (x.a + x.b)) / (x.a + x.b + 1))"

ORACLE = rf"""
WITH p AS (SELECT page_id, url, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''),
        '{_UPPER}', '{_LOWER}') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
q AS (SELECT *, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix FROM p),
lab AS (SELECT doc_id, min(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
hosts AS (SELECT host, domain, suffix, count(*) AS n, sum(good) AS good FROM q JOIN lab
    ON try_cast(regexp_extract(url, '^[^?#]*/(\d+)(?:/|\.html)?(?:[?#].*)?$', 1) AS BIGINT) = doc_id GROUP BY ALL),
overall AS (SELECT (sum(good) + 1.0) / (sum(n) + 2.0) AS p FROM hosts),
{_level("suffix", "suffix", None)},
{_level("domain", "suffix, domain", "suffix")},
{_level("host", "suffix, domain, host", "domain").replace("USING (domain)", "ON g.domain = u.domain AND g.suffix = u.suffix")},
s AS (SELECT suffix, {_UP} AS u FROM suffix_b x), d AS (SELECT domain, {_UP} AS u FROM domain_b x),
h AS (SELECT host, {_UP} AS u FROM host_b x)
SELECT page_id, host, path,
    CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule,
    CASE rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block' WHEN 'example.net/en/' THEN 'allow'
         WHEN 'org/fr/' THEN 'allow'
         ELSE CASE WHEN coalesce(h.u, d.u, s.u, overall.p) < 0.5 THEN 'block' ELSE 'allow' END END AS verdict
FROM q LEFT JOIN h USING (host) LEFT JOIN d USING (domain) LEFT JOIN s USING (suffix), overall
"""

QUERIES = {"op8_urlfilter": op8_urlfilter}
ORACLE_SQL = {"op8_urlfilter": ORACLE}
