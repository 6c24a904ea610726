"""URL filters: a dated block list as validity intervals, joined to captures as of their fetch time.

Main path: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def host_of(url: Column) -> Column:
    """Lower-case host without port, user or trailing dots, an IPv6 address in its brackets; null for anything that has none."""
    host = F.lower(F.regexp_extract(url, r"^\s*(?i:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?(\[[0-9a-fA-F:.]+\]|[^/?#:@\[\]]+)", 1))
    return F.nullif(F.rtrim(host, F.lit(".")), F.lit(""))


def suffixes(host: Column) -> Column:
    """A host and all its parent domains of two labels or more, longest first; a host of one label, or an address, is its own."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    cut = F.transform(F.sequence(n, F.least(n, F.lit(2)), F.lit(-1)), lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))
    return F.when(host.rlike(r"^(\[.*\]|[0-9.]+)$"), F.array(host)).when(host.isNotNull(), cut)


def intervals(entries: DataFrame) -> DataFrame:
    """(domain, category, valid_from, valid_to) of entries(domain, category, effective, active).

    Each entry holds from its date until the next entry of its domain and category; valid_to is
    exclusive and null while the entry is the last. Of entries with one date, an active one wins;
    repeated entries and those that say what already holds change nothing. Entries with a null
    domain, date or state are void; a null category is a category of its own.
    """
    entries = entries.select(F.lower("domain").alias("domain"), "category", "effective", "active").dropna(subset=["domain", "effective", "active"])
    daily = entries.groupBy("domain", "category", "effective").agg(F.bool_or("active").alias("active"))
    w = Window.partitionBy("domain", "category").orderBy("effective")
    turned = daily.withColumn("was", F.lag("active").over(w)).filter(F.col("active") != F.coalesce("was", F.lit(False)))
    return turned.withColumn("valid_to", F.lead("effective").over(w)).filter("active").select("domain", "category", F.col("effective").alias("valid_from"), "valid_to")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """capture_id, url, host, fetched_at, blocked, matches (sorted array of domain and category) for each row of
    captures(capture_id, url, fetched_at), against the entries active at fetched_at.

    An entry for a domain of two labels or more covers its subdomains; one of a single label covers
    that host alone. Captures without a host or time are never
    blocked and have no matches. Repeated captures get a row each; other columns are ignored; without
    captures there are no rows, without entries nothing is blocked. Urls of any length are read whole.
    Verdicts are worked out once for each host and time, however many captures share them.
    """
    seen = captures.select("capture_id", "url", host_of(F.col("url")).alias("host"), "fetched_at")
    asked = seen.select("host", "fetched_at").dropna().distinct()
    looked = asked.select("host", "fetched_at", F.explode(suffixes(F.col("host"))).alias("domain"))
    spans = intervals(entries)
    active = looked.join(spans, "domain").filter("fetched_at >= valid_from and (valid_to is null or fetched_at < valid_to)")
    verdicts = active.groupBy("host", "fetched_at").agg(F.sort_array(F.collect_set(F.concat_ws(":", "domain", "category"))).alias("matches"))
    return seen.join(verdicts, ["host", "fetched_at"], "left").select(
        "capture_id", "url", "host", "fetched_at", F.col("matches").isNotNull().alias("blocked"), F.coalesce("matches", F.array().cast("array<string>")).alias("matches")
    )


#: The tables have no dates, so both sides' dates come from the rows themselves: a capture's from its page_id, an entry's from its domain's MD5.
FIRST_DAY, DAYS = "2024-01-01", 366


def captures_of(pages: DataFrame) -> DataFrame:
    day = F.date_add(F.to_date(F.lit(FIRST_DAY)), F.pmod(F.col("page_id") * 7919, F.lit(DAYS)).cast("int"))
    return pages.select(F.col("page_id").alias("capture_id"), "url", day.alias("fetched_at"))


def entries_of(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts and parent domains of the pages: a third of them are listed,
    half of the listed are dropped later, and some of these come back."""
    domains = pages.select(F.explode(suffixes(host_of(F.col("url")))).alias("domain")).distinct()
    part = lambda k: F.conv(F.substring(F.md5("domain"), 1 + 4 * k, 4), 16, 10).cast("int")
    listed = domains.filter(F.pmod(part(0), F.lit(3)) == 0)
    at = lambda k, off: F.date_add(F.to_date(F.lit(FIRST_DAY)), (F.pmod(part(k), F.lit(120)) + off).cast("int"))
    category = F.when(F.pmod(part(1), F.lit(2)) == 0, "adult").otherwise("spam")
    rows = F.array(
        F.struct(at(2, 0).alias("effective"), F.lit(True).alias("active"), F.lit(True).alias("there")),
        F.struct(at(3, 120).alias("effective"), F.lit(False).alias("active"), (F.pmod(part(4), F.lit(2)) == 0).alias("there")),
        F.struct(at(5, 240).alias("effective"), F.lit(True).alias("active"), (F.pmod(part(4), F.lit(4)) == 0).alias("there")),
    )
    return listed.select("domain", category.alias("category"), F.inline(rows)).filter("there").drop("there")


def op10_temporal_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    out = evaluate(captures_of(pages), entries_of(pages))
    return out.select(F.col("capture_id").alias("page_id"), "url", "host", F.date_format("fetched_at", "yyyy-MM-dd").alias("fetched_at"), "blocked", F.array_join("matches", "|").alias("matches"))


ORACLE_SQL = """
WITH seen AS (
  SELECT page_id, url, nullif(rtrim(lower(regexp_extract(url, '^\\s*(?i:[a-z][a-z0-9+.\\-]*:)?//(?:[^/?#@]*@)?(\\[[0-9a-fA-F:.]+\\]|[^/?#:@\\[\\]]+)', 1)), '.'), '') AS host,
         DATE '2024-01-01' + CAST(((page_id * 7919) % 366 + 366) % 366 AS INTEGER) AS fetched_at
  FROM pages),
hosts AS (SELECT DISTINCT host, string_split(host, '.') AS labels FROM seen WHERE host IS NOT NULL),
suffix AS (
  SELECT DISTINCT host, array_to_string(labels[len(labels) - k + 1:], '.') AS domain
  FROM hosts, unnest(generate_series(least(len(labels), 2), len(labels))) AS g(k) WHERE NOT regexp_matches(host, '^(\\[.*\\]|[0-9.]+)$')
  UNION SELECT host, host FROM hosts),
part AS (
  SELECT domain, [CAST('0x' || substr(md5(domain), 1 + 4 * k, 4) AS INTEGER) FOR k IN range(6)] AS p
  FROM (SELECT DISTINCT domain FROM suffix)),
spans AS (
  SELECT domain, CASE WHEN p[2] % 2 = 0 THEN 'adult' ELSE 'spam' END AS category, DATE '2024-01-01' + p[3] % 120 AS valid_from,
         CASE WHEN p[5] % 2 = 0 THEN DATE '2024-01-01' + (p[4] % 120 + 120) END AS valid_to
  FROM part WHERE p[1] % 3 = 0
  UNION ALL
  SELECT domain, CASE WHEN p[2] % 2 = 0 THEN 'adult' ELSE 'spam' END, DATE '2024-01-01' + (p[6] % 120 + 240), NULL
  FROM part WHERE p[1] % 3 = 0 AND p[5] % 4 = 0),
hit AS (
  SELECT page_id, string_agg(DISTINCT s.domain || ':' || category, '|' ORDER BY s.domain || ':' || category) AS matches
  FROM seen JOIN suffix USING (host) JOIN spans s ON s.domain = suffix.domain AND fetched_at >= valid_from AND (valid_to IS NULL OR fetched_at < valid_to)
  GROUP BY page_id)
SELECT seen.page_id, url, host, strftime(fetched_at, '%Y-%m-%d') AS fetched_at, matches IS NOT NULL AS blocked, coalesce(matches, '') AS matches
FROM seen LEFT JOIN hit ON hit.page_id = seen.page_id
"""
