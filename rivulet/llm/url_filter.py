"""URL filters by temporal list join.

Dated list entries become validity intervals; every capture is joined, as of its fetch time, with the entries of the
lists that were active then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def url_host(url: Column) -> Column:
    """Lower-case host of an absolute URL, without user, port and trailing dots; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    host = F.regexp_replace(host, r"\.+$", "")
    return F.when(host != "", host)


def domain_suffixes(host: Column) -> Column:
    """The host and every parent domain, longest first: a.b.c gives a.b.c, b.c, c."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(list_name, pattern, category, active, listed_at) events to (list_name, pattern, category, valid_from, valid_to).

    The latest event at or before an instant holds; several at one instant: removal wins over listing, then the
    smallest category counts. Events without pattern, list or date are void. valid_to is exclusive, null: open.
    """
    events = (
        entries.select("list_name", F.regexp_replace(F.lower(F.trim("pattern")), r"^\.+|\.+$", "").alias("pattern"), "category", F.coalesce("active", F.lit(True)).alias("active"), "listed_at")
        .where("list_name IS NOT NULL AND pattern <> '' AND listed_at IS NOT NULL")
        .groupBy("list_name", "pattern", "listed_at")
        .agg(F.min("active").alias("active"), F.min("category").alias("category"))
    )
    after = F.lead("listed_at").over(Window.partitionBy("list_name", "pattern").orderBy("listed_at"))
    return events.withColumn("valid_to", after).where("active").select("list_name", "pattern", "category", F.col("listed_at").alias("valid_from"), "valid_to")


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """One row per capture: id, host, fetched_at, blocked, n_entries, matched_list, matched_pattern, matched_category.

    A capture matches an entry if its host equals the entry's pattern or lies below it, and the entry was active at
    the fetch time. The longest pattern is reported, then the smallest list name. Nulls: a capture without URL, host
    or time matches nothing and is kept as not blocked; repeated captures each give a row; no entries, no match.
    Other columns of captures and entries are ignored, whatever their names.

    The join is on the domain, so a busy domain is split by adaptive execution; the entries of one domain are its
    listing periods only. Matches are reduced to one row per capture by a combining maximum.
    """
    base = captures.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(time_col).alias("_at"))
    base = base.withColumn("_host", url_host(F.col("_url")))
    intervals = validity_intervals(entries).select(*(F.col(c).alias(f"_e_{c}") for c in ("list_name", "pattern", "category", "valid_from", "valid_to")))
    probes = base.select("_row", "_id", "_at", "_host", F.explode_outer(domain_suffixes(F.col("_host"))).alias("_domain"))
    met = probes.join(intervals, (F.col("_domain") == F.col("_e_pattern")) & (F.col("_e_valid_from") <= F.col("_at")) & (F.col("_e_valid_to").isNull() | (F.col("_at") < F.col("_e_valid_to"))), "left")
    hit = F.when(F.col("_e_pattern").isNotNull(), F.struct((-F.length("_e_pattern")).alias("len"), F.col("_e_list_name").alias("l"), F.col("_e_pattern").alias("p"), F.col("_e_category").alias("c")))
    # _row differs between runs of a task, but every row of a capture is made by the same one
    out = met.groupBy("_row", "_id", "_at", "_host").agg(F.count("_e_pattern").alias("n_entries"), F.min(hit).alias("_hit"))
    return out.select(
        F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_at").alias("fetched_at"), (F.col("n_entries") > 0).alias("blocked"), "n_entries",
        F.col("_hit.l").alias("matched_list"), F.col("_hit.p").alias("matched_pattern"), F.col("_hit.c").alias("matched_category"),
    )


# ---------------------------------------------------------------------------------------------------------------
# The tables hold no lists and no fetch times, so the query derives both by fixed rules.

DAY0 = "2024-01-01"


def digest_number(col: Column, start: int = 1, width: int = 4) -> Column:
    """Hex digits of the MD5 as a number; the same in any SQL dialect."""
    return F.conv(F.substring(F.md5(col), start, width), 16, 10).cast("long")


def example_entries(pages: DataFrame) -> DataFrame:
    """Blocklist events for a fifth of the hosts and their parents with two labels: listed, removed, listed again."""
    hosts = pages.select(url_host(F.col("url")).alias("h")).where("h IS NOT NULL").distinct()
    domains = hosts.union(hosts.select(F.regexp_extract("h", r"([^.]+\.[^.]+)$", 1))).where("h <> ''").distinct()
    d = domains.where(digest_number(F.col("h")) % 5 == 0).withColumn("d0", digest_number(F.col("h"), 5) % 300)
    day = lambda c: F.timestamp_seconds(F.unix_timestamp(F.lit(f"{DAY0} 00:00:00")) + c * 86400)
    return d.select(F.explode(F.array(
        *(F.struct(F.lit(name).alias("list_name"), F.col("h").alias("pattern"), F.lit(cat).alias("category"), F.lit(on).alias("active"), day(F.col("d0") + add).alias("listed_at"))
          for name, cat, on, add in (("ads", "adverts", True, 0), ("ads", "adverts", False, 40), ("ads", "adverts", True, 90), ("malware", "unsafe", True, 20), ("malware", "unsafe", False, 60)))
    )).alias("e")).select("e.*")


def example_captures(pages: DataFrame) -> DataFrame:
    """Every page with a fetch time: a number of days after DAY0 fixed by page_id."""
    at = F.timestamp_seconds(F.unix_timestamp(F.lit(f"{DAY0} 00:00:00")) + F.pmod(F.col("page_id") * 37, F.lit(400)) * 86400 + 43200)
    return pages.select("page_id", "url", at.alias("fetched_at"))


def op9_query(pages: DataFrame) -> DataFrame:
    return filter_urls(example_captures(pages), example_entries(pages))


OP9_SQL = """
WITH p AS (SELECT page_id, url, TIMESTAMP '2024-01-01 12:00:00' + to_days(CAST((page_id * 37) % 400 AS INTEGER)) AS fetched_at,
  nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\\.+$', ''), '') AS host FROM pages),
h AS (SELECT DISTINCT host AS h FROM p WHERE host IS NOT NULL),
d AS (SELECT DISTINCT h FROM (SELECT h FROM h UNION ALL SELECT regexp_extract(h, '([^.]+\\.[^.]+)$', 1) FROM h) WHERE h <> ''),
e AS (SELECT h, CAST('0x' || substr(md5(h), 5, 4) AS BIGINT) % 300 AS d0 FROM d WHERE CAST('0x' || substr(md5(h), 1, 4) AS BIGINT) % 5 = 0),
v AS (SELECT l, h, c, TIMESTAMP '2024-01-01' + to_days(CAST(d0 + f AS INTEGER)) AS a, CASE WHEN t IS NULL THEN NULL ELSE TIMESTAMP '2024-01-01' + to_days(CAST(d0 + t AS INTEGER)) END AS b
  FROM e, (VALUES ('ads', 'adverts', 0, 40), ('ads', 'adverts', 90, NULL), ('malware', 'unsafe', 20, 60)) AS x(l, c, f, t)),
m AS (SELECT p.page_id, v.* FROM p JOIN v ON (p.host = v.h OR p.host LIKE '%.' || v.h) AND v.a <= p.fetched_at AND (v.b IS NULL OR p.fetched_at < v.b)),
r AS (SELECT *, count(*) OVER (PARTITION BY page_id) AS n, row_number() OVER (PARTITION BY page_id ORDER BY length(h) DESC, l) AS k FROM m)
SELECT p.page_id, p.host, p.fetched_at, r.page_id IS NOT NULL AS blocked, coalesce(r.n, 0) AS n_entries, r.l AS matched_list, r.h AS matched_pattern, r.c AS matched_category
FROM p LEFT JOIN r ON p.page_id = r.page_id AND r.k = 1
"""
