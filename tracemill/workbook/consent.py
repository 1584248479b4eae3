"""Page addresses as working directories: consent resolution and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions.digests import hmac_hex
from tracemill.operators.consent import (
    ambiguous_entries,
    attach_consent,
    nested_roots,
    resolve_directories,
    under_roots,
)
from tracemill.sources.consent_table import Signing, boundless_signature, signature, trusted_consent
from tracemill.workbook.facts import sql_hmac
from tracemill.workbook.registry import query

SALT = b"workbook salt"
_URL = r"^https?://([^/?#]+)([^?#]*)"


def _pages(pages: DataFrame) -> DataFrame:
    host = F.regexp_extract("url", _URL, 1)
    path = F.regexp_extract("url", _URL, 2)
    return pages.select("page_id", host.alias("host"), path.alias("path"), F.split_part(path, F.lit("/"), F.lit(2)).alias("head"))


_PAGES = rf"""p AS (
  SELECT page_id, regexp_extract(url, '{_URL}', 1) AS host, regexp_extract(url, '{_URL}', 2) AS path,
         split_part(regexp_extract(url, '{_URL}', 2), '/', 2) AS head FROM pages)"""


def _directories(pages: DataFrame) -> DataFrame:
    """(page_id, cwd): some spelled in capitals, some with dot elements, some relative."""
    n = F.col("page_id")
    host = F.when(n % 7 == 0, F.upper("host")).otherwise(F.col("host"))
    dots = F.when(n % 6 == 0, F.lit("/./x/../")).otherwise(F.lit("/"))
    lead = F.when(n % 41 == 0, F.lit("")).otherwise(F.lit("/"))
    return _pages(pages).select("page_id", F.concat(lead, host, dots, F.ltrim(F.col("path"), F.lit("/"))).alias("cwd"))


# The same directories spelled out clean, and the raw text.
_DIRS = _PAGES + r""", d AS (
  SELECT page_id,
    CASE WHEN page_id % 41 = 0 THEN '' ELSE '/' END || CASE WHEN page_id % 7 = 0 THEN upper(host) ELSE host END ||
      CASE WHEN page_id % 6 = 0 THEN '/./x/../' ELSE '/' END || ltrim(path, '/') AS cwd,
    CASE WHEN page_id % 41 = 0 THEN NULL ELSE
      rtrim(regexp_replace('/' || CASE WHEN page_id % 7 = 0 THEN upper(host) ELSE host END || '/' || ltrim(path, '/'), '/+', '/', 'g'), '/') END AS clean
  FROM p)"""


def _consent(pages: DataFrame) -> DataFrame:
    """Every host is a consented root, and some first path elements below it are their own."""
    hosts = _pages(pages)
    wide = hosts.select(F.concat(F.lit("/"), "host").alias("root")).distinct().select(
        F.lit(0).alias("entry"), "root", (F.length("root") % 2 == 0).alias("case_insensitive"),
        F.to_timestamp(F.lit("2024-01-10T00:00:00Z")).alias("collect_from"),
    ).where(F.length("root") % 5 != 0)
    deep = hosts.where((F.col("page_id") % 4 == 0) & (F.col("head") != "")).select(
        F.concat(F.lit("/"), "host", F.lit("/"), "head").alias("root")).distinct().select(
        F.lit(1).alias("entry"), "root", F.lit(False).alias("case_insensitive"), F.lit(None).cast("timestamp").alias("collect_from"))
    return wide.unionByName(deep).select(
        "entry", F.md5("root").alias("id"), "root", F.array().cast("array<string>").alias("aliases"),
        "case_insensitive", "collect_from",
    )


_ROOTS = """roots AS (
  SELECT DISTINCT '/' || host AS root, length('/' || host) % 2 = 0 AS fold, TIMESTAMP '2024-01-10' AS collect_from FROM p
  WHERE length('/' || host) % 5 <> 0
  UNION ALL
  SELECT DISTINCT '/' || host || '/' || head, false, NULL FROM p WHERE page_id % 4 = 0 AND head <> ''
), hits AS (
  SELECT d.page_id, d.cwd, d.clean, r.root, r.collect_from FROM d LEFT JOIN roots r
    ON CASE WHEN r.fold THEN lower(d.clean) = lower(r.root) OR starts_with(lower(d.clean), lower(r.root) || '/')
            ELSE d.clean = r.root OR starts_with(d.clean, r.root || '/') END
  QUALIFY row_number() OVER (PARTITION BY d.page_id ORDER BY length(r.root) DESC NULLS LAST) = 1)"""


@query("consent_resolution", f"""WITH {_DIRS}, {_ROOTS}
SELECT page_id, root, root IS NOT NULL AS matched,
       CASE WHEN root IS NOT NULL THEN md5(root) ELSE substr({sql_hmac(SALT, 'clean')}, 1, 32) END AS repo
FROM hits""")
def _(spark, tables):
    rows = _directories(tables("pages"))
    resolved = resolve_directories(rows, _consent(tables("pages")), SALT)
    return rows.join(resolved, "cwd").select("page_id", "root", "matched", "repo")


@query("collection_window", f"""WITH {_DIRS}, {_ROOTS}
SELECT e.event_id, h.root IS NOT NULL AND coalesce(e.ts >= h.collect_from, true) AS consented
FROM events e JOIN hits h ON h.page_id = e.user_id""")
def _(spark, tables):
    rows = _directories(tables("pages"))
    visits = tables("events").join(rows, F.col("user_id") == F.col("page_id")).select("event_id", "cwd", F.col("ts").cast("timestamp"))
    directories = resolve_directories(rows, _consent(tables("pages")), SALT)
    return attach_consent(visits, directories, "window").select("event_id", "consented")


@query("under_root", f"""WITH {_DIRS}
SELECT DISTINCT d.page_id FROM d JOIN (SELECT DISTINCT '/' || host AS root FROM p WHERE length(host) % 3 = 0) r
  ON d.cwd = r.root OR starts_with(d.cwd, r.root || '/')""")
def _(spark, tables):
    roots = _pages(tables("pages")).where(F.length("host") % 3 == 0).select(F.concat(F.lit("/"), "host").alias("root"))
    return under_roots(_directories(tables("pages")), roots).select("page_id")


def _registered(pages: DataFrame) -> DataFrame:
    """One registered entry per page; ids, roots and aliases collide on purpose."""
    n = F.col("page_id")
    clean = F.rtrim(F.concat(F.lit("/"), "host", "path"), F.lit("/"))
    return _pages(pages).select(
        n.alias("entry"),
        # Every tenth page repeats the id of the page before it, every fifth alias that of the alias before.
        F.md5((n - (n % 10 == 3).cast("int")).cast("string")).alias("id"),
        F.when(n % 9 == 0, F.concat(F.lit("/"), "host")).when(n % 10 == 0, F.upper(clean)).otherwise(clean).alias("root"),
        F.when(n % 8 == 0, F.array(F.concat(F.lit("/alt/"), n - 8 * (n % 40 == 8).cast("int")))).otherwise(F.array().cast("array<string>")).alias("aliases"),
        (n % 5 == 0).alias("case_insensitive"), F.lit(None).cast("timestamp").alias("collect_from"),
    )


_REGISTERED = _PAGES + """, reg AS (
  SELECT page_id AS entry, md5(CAST(page_id - CASE WHEN page_id % 10 = 3 THEN 1 ELSE 0 END AS VARCHAR)) AS id, page_id % 5 = 0 AS fold,
         CASE WHEN page_id % 9 = 0 THEN '/' || host WHEN page_id % 10 = 0 THEN upper(rtrim('/' || host || path, '/'))
              ELSE rtrim('/' || host || path, '/') END AS root,
         CASE WHEN page_id % 8 = 0 THEN '/alt/' || (page_id - CASE WHEN page_id % 40 = 8 THEN 8 ELSE 0 END) END AS alias FROM p
), sp AS (SELECT entry, id, fold, root AS s FROM reg UNION ALL SELECT entry, id, fold, alias FROM reg WHERE alias IS NOT NULL)"""


@query("ambiguous_consent", f"""WITH {_REGISTERED}
SELECT entry FROM reg WHERE id IN (SELECT id FROM reg GROUP BY id HAVING count(*) > 1)
   OR root IN (SELECT root FROM reg GROUP BY root HAVING count(*) > 1)
   OR entry IN (SELECT entry FROM sp WHERE s IN (SELECT s FROM sp GROUP BY s HAVING count(*) > 1))""")
def _(spark, tables):
    return ambiguous_entries(_registered(tables("pages")))


@query("nested_roots", f"""WITH {_REGISTERED}, met AS (
  SELECT a.entry AS e1, a.id AS id1, b.entry AS e2, b.id AS id2 FROM sp a JOIN sp b ON a.entry <> b.entry AND
    CASE WHEN a.fold OR b.fold THEN lower(a.s) = lower(b.s) OR starts_with(lower(a.s), lower(b.s) || '/')
         ELSE a.s = b.s OR starts_with(a.s, b.s || '/') END)
SELECT e1 AS entry, id1 AS id, 'inside' AS relation, arg_min(id2, e2) AS other_id FROM met GROUP BY ALL
UNION ALL
SELECT e2, id2, 'contains', arg_min(id1, e1) FROM met GROUP BY e2, id2""")
def _(spark, tables):
    return nested_roots(_registered(tables("pages")))


SIGNING = Signing(SALT)


@query("consent_trust", """WITH c AS (
  SELECT c_custkey AS n, '/home/u' || (c_custkey - CASE WHEN c_custkey % 12 = 7 THEN 1 ELSE 0 END) AS root,
         c_custkey % 17 = 0 AS slash_label, c_custkey % 19 = 0 AS bad_boundary, c_custkey % 4 = 0 AS bounded,
         c_custkey % 10 = 3 AS bad_id, c_custkey % 11 = 5 AS tampered, c_custkey % 6 = 1 AS old_form,
         CASE WHEN c_custkey % 7 = 0 THEN '/alt/' || c_custkey END AS alias FROM customer
), judged AS (
  SELECT *, CASE WHEN slash_label OR bad_boundary OR n % 23 = 0 THEN 'malformed' WHEN bad_id OR tampered THEN 'unsigned'
    WHEN old_form AND bounded THEN 'unsigned' ELSE 'signed' END AS first FROM c)
SELECT n AS entry, CASE WHEN first <> 'signed' THEN first
       WHEN count(*) FILTER (first = 'signed') OVER (PARTITION BY root) > 1 THEN 'ambiguous' ELSE 'trusted' END AS verdict
FROM judged""")
def _(spark, tables):
    customer = tables("customer")
    n = F.col("c_custkey")
    # Every twelfth customer names the root of the one before.
    root = F.concat(F.lit("/home/u"), n - (n % 12 == 7).cast("int"))
    entries = customer.select(
        n.alias("entry"),
        F.substr(hmac_hex(SALT, F.when(n % 10 == 3, F.lit("elsewhere")).otherwise(root)), F.lit(1), F.lit(32)).alias("id"),
        F.when(n % 17 == 0, "a/b").otherwise("repo").alias("label"),
        F.when(n % 23 == 0, F.concat(root, F.lit("/"))).otherwise(root).alias("root"),
        F.when(n % 7 == 0, F.array(F.concat(F.lit("/alt/"), n))).otherwise(F.array().cast("array<string>")).alias("aliases"),
        (n % 3 == 0).alias("case_insensitive"),
        F.when(n % 19 == 0, "2024-01-01 00:00:00").when(n % 4 == 0, "2024-01-01T00:00:00Z").otherwise("").alias("collect_from"),
    )
    proper = F.when(F.col("entry") % 6 == 1, boundless_signature(SIGNING)).otherwise(signature(SIGNING))
    signed = entries.withColumn(
        "match_mac", F.when(F.col("entry") % 11 == 5, F.sha2("root", 256)).otherwise(proper)
    )
    return trusted_consent(signed, SIGNING).select("entry", "verdict")
