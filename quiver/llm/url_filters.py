r"""URL filters: pattern rules, fetched by their rarest literal token.

Two kinds of rules stand in one table (rule, verdict, host, path, pattern):

* *site rules* (host, path) fit the host and all its subdomains where the URL's
  path starts with the rule's path; an empty host is every host, an empty path
  every path;
* *patterns* fit anywhere in the lower-cased URL: ``*`` is any run of characters,
  ``^`` one character that is no letter or digit, or the end; the rest is literal.

Every rule becomes a regular expression and the set of its *literal tokens*: the
runs of ``[a-z0-9]`` that no matching URL can lack, bounded by other literal
characters on both sides.  Each rule is indexed by that one of its tokens which
the fewest URLs hold (counted over all URLs); a rule without such a token is
indexed by the empty token, which every URL holds.  The tokens of a URL fetch its
candidate rules, and only those run their expression.  Site rules come before
patterns, longer rules before shorter ones, then the order of the rule texts.

DataFrame functions only.  The URLs are shuffled once, one row each, after their
candidates have been reduced to the best rule in place.  The index is broadcast
while its measured size is within ``BROADCAST_BYTES``; larger rule sets are joined
by shuffle, token and salt.

Defined cases: a null URL, or one without ``://``, has an empty host and path, and
no site rule fits it; a rule without a verdict, or with neither host nor pattern,
is ignored; an empty path does not start with ``/``; rows that repeat are judged
each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quiver.llm import common as C

#: Bound on a broadcast rule index, measured before it is used.
BROADCAST_BYTES = 32 << 20
#: Parts into which the URLs of one token are dealt where the index is not broadcast.
SALTS = 32

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE_COLUMNS = "rule, verdict, host, path, pattern"

# The site rules of the query, as (verdict, host, path).
SITES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
# Patterns for what no site rule fits (gambling, drugs, adult, advertising and spam hosts).
PATTERNS = [("block", "^adult^"), ("block", "^ads-track^"), ("block", "^bets^"), ("block", "^casino^"), ("block", "^pills^"),
            ("block", "^spam-farm^")]
#: The verdict on a URL that no rule fits.
DEFAULT = "allow"


def rule_table(spark: SparkSession, sites=SITES, patterns=PATTERNS) -> DataFrame:
    """The rules as a table; a literal relation of the plan."""
    text = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = [f"({text(h + p)}, {text(v)}, {text(h)}, {text(p)}, cast(null as string))" for v, h, p in sites]
    rows += [f"({text(p)}, {text(v)}, cast(null as string), cast(null as string), {text(p)})" for v, p in patterns]
    return spark.sql(f"select * from values {', '.join(rows)} as t({RULE_COLUMNS})" if rows else
                     "select '' rule, '' verdict, '' host, '' path, '' pattern where false")


def lower(c: Column) -> Column:
    """A-Z only, so that tokens mean the same everywhere."""
    return F.translate(c, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands after the first ``://`` up to / ? # (lower-cased), and then up to ? #."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    head = F.substring_index(F.substring_index(F.coalesce(rest, F.lit("")), "?", 1), "#", 1)
    host = F.substring_index(head, "/", 1)
    return lower(host), F.substr(head, F.char_length(host) + 1)


def url_tokens(url: Column) -> Column:
    """The distinct tokens of a URL, the empty one always among them."""
    return F.array_union(F.split(lower(F.coalesce(url, F.lit(""))), "[^a-z0-9]+"), F.array(F.lit("")))


def _literal(c: Column) -> Column:
    return F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def compiled(rules: DataFrame) -> DataFrame:
    """id (its place in the order of preference), rule, verdict, on_site, regex, tokens."""
    host, path, pattern = lower(F.col("host")), F.coalesce("path", F.lit("")), lower(F.col("pattern"))
    site = F.concat(F.when(host == "", F.lit("^[^/]*")).otherwise(F.concat(F.lit("^(?:[^/]*\\.)?"), _literal(host))),
                    F.when(path == "", F.lit("(?:/|\\z)")).otherwise(_literal(path)))
    parts = F.transform(F.split(pattern, "(?<=[*^])|(?=[*^])"), lambda p: F.when(p == "*", F.lit(".*")).when(
        p == "^", F.lit("(?:[^a-z0-9]|\\z)")).otherwise(_literal(p)))
    on_site = F.col("host").isNotNull()
    known = F.when(on_site, F.concat(F.lit("."), host, F.when(path == "", F.lit("/")).otherwise(lower(path)))).otherwise(pattern)
    out = rules.where("verdict is not null and (host is not null or pattern is not null)").select(
        F.coalesce("rule", F.lit("")).alias("rule"), "verdict", on_site.alias("on_site"),
        F.when(on_site, site).otherwise(F.concat(F.lit("(?s)"), F.array_join(parts, ""))).alias("regex"),
        F.array_distinct(F.regexp_extract_all(known, F.lit("(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])"), 0)).alias("tokens"))
    first = Window.orderBy(F.col("on_site").desc(), F.char_length("rule").desc(), "rule", "verdict", "regex")
    return out.withColumn("id", F.row_number().over(first).cast("long"))


def _fits(df: DataFrame) -> bool:
    size = df.agg(F.sum(F.char_length(F.concat_ws(" ", *[F.col(c).cast("string") for c in df.columns])) + 64)).first()[0]
    return (size or 0) <= BROADCAST_BYTES


def rule_index(urls: DataFrame, rules: DataFrame, small: bool) -> DataFrame:
    """(token, id, on_site, regex): each compiled rule under the rarest of its tokens over all ``urls``."""
    own = rules.select("id", F.explode("tokens").alias("token"))
    wanted = own.select("token").distinct()
    tokens = urls.select(F.explode(url_tokens(F.col("url"))).alias("token"))
    if small:
        counts = tokens.join(F.broadcast(wanted), "token").groupBy("token").count()
    else:
        counts = tokens.groupBy("token").count().join(wanted, "token")
    rarest = own.join(counts, "token", "left").groupBy("id").agg(
        F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    return rules.join(rarest, "id", "left").select(F.coalesce("token", F.lit("")).alias("token"), "id", "on_site", "regex")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, small: bool | None = None) -> DataFrame:
    """page_id, host, path, rule (the site rule that fits, else null), pattern (the pattern that decides, else
    null) and verdict of every row of (page_id, url).  ``small``: whether the rules are broadcast; None measures them."""
    urls = pages.select("page_id", F.col("url").cast("string").alias("url"))
    rules = C.written(compiled(rules), "url-rules")
    small = _fits(rules) if small is None else small
    index = rule_index(urls, rules, small)
    # one entry a token and one that fetches nothing and stands for the row itself; repeated rows are
    # counted within their own input partition, so that no number of them can gather in one place
    row = F.concat(F.lit("#"), F.xxhash64("page_id", "url").cast("string"))
    entries = urls.select("page_id", "url", F.spark_partition_id().alias("part"),
                          F.explode(F.concat(url_tokens(F.col("url")), F.array(row))).alias("token"))
    if small:
        fetched = entries.join(F.broadcast(index), "token", "left")
    else:
        salted = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
        fetched = entries.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))).join(salted, ["token", "salt"], "left")
    host, path = host_and_path(F.col("url"))
    subject = F.when(F.col("on_site"), F.concat(host, path)).otherwise(lower(F.col("url")))
    best = fetched.groupBy("page_id", "url", "part").agg(
        F.min(F.when(F.rlike(subject, F.col("regex")), F.col("id"))).alias("id"), F.count_if(F.startswith("token", F.lit("#"))).alias("copies"))
    names = rules.select("id", "on_site", "rule", F.col("verdict").alias("found"))
    out = best.join(F.broadcast(names) if small else names, "id", "left")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("page_id", host.alias("host"), path.alias("path"), F.when(F.col("on_site"), F.col("rule")).alias("rule"),
                      F.when(~F.col("on_site"), F.col("rule")).alias("pattern"), F.coalesce("found", F.lit(default)).alias("verdict"))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule and verdict of every url of ``pages``."""
    C.prepare(spark)
    return filter_urls(C.table(spark, sf_dir, "pages"), rule_table(spark)).drop("pattern")


ORACLE_SQL = rf"""
WITH head AS (SELECT page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS low,
    CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS head FROM pages),
site AS (SELECT page_id, low, translate(regexp_extract(head, '^[^/]*'), '{UPPER}', '{LOWER}') AS host,
    substr(head, length(regexp_extract(head, '^[^/]*')) + 1) AS path FROM head),
ruled AS (SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM site)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN regexp_matches(low, '[^a-z0-9](adult|ads-track|bets|casino|pills|spam-farm)([^a-z0-9]|\z)') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled"""
