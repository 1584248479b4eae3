"""Parts as a catalog, line items as its use; pages and suppliers as layouts and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions.classify import is_failure
from tracemill.plans.inventory import (
    UsageSnapshots,
    carry_forward,
    catalog,
    catalog_usage,
    mcp_servers_of_tools,
    order_catalog,
    order_snapshot,
)
from tracemill.plans.jobs import primitives_of, report_of
from tracemill.plans.marts import unused_overview, unused_primitives, used_primitives
from tracemill.operators.usage import usage_by_primitive
from tracemill.session import materialize, scratch_path, spread
from tracemill.sources.catalog_files import announced_primitives, listed_primitives, mcp_servers, plugin_paths, primitives_in_layout
from tracemill.sources.lines import frame
from tracemill.sources.transcripts import decode_entries
from tracemill.schemas import INVOCATION
from tracemill.workbook.registry import query
from tracemill.workbook.transcripts import NAME_KEY

_KINDS = ["skill", "subagent", "command", "mcp_tool", "mcp_server", "builtin_tool"]


def _kind(key: str):
    return F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col(key) % 6 + 1).cast("int"))


#: A part is listed once per supplier group; what no supplier of a group sold is unused, at any scale.
GROUPS = 25
PARTS_A_TASK = 20_000


def part_catalog(part: DataFrame) -> DataFrame:
    """Each part in every group; the rows are dealt out first, since a task would list all the parts of a small file."""
    parts = spread(part.select("p_partkey"), PARTS_A_TASK)
    listed = parts.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(GROUPS - 1))))
    return listed.select(F.lit("shop").alias("harness"), _kind("p_partkey").alias("kind"),
                         F.concat(F.lit("p"), "p_partkey", F.lit("g"), "g").alias("name"))


def sales_facts(lineitem: DataFrame) -> DataFrame:
    """Line items as records of the part and supplier group they sell."""
    made = {
        "ts": F.col("l_shipdate"), "harness": F.lit("shop"), "kind": _kind("l_partkey"),
        "name": F.concat(F.lit("p"), "l_partkey", F.lit("g"), F.col("l_suppkey") % GROUPS), "session_id": F.concat(F.lit("o"), "l_orderkey"),
        "outcome": F.when(F.col("l_returnflag") == "R", "error").when(F.col("l_returnflag") == "A", "ok"),
    }
    return lineitem.select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in INVOCATION.fields])


def sold(tables) -> DataFrame:
    return catalog_usage(part_catalog(tables("part")), usage_by_primitive(sales_facts(tables("lineitem"))))


_SOLD = f"""sold AS (
  SELECT 'shop' AS harness, CASE p_partkey % 6 WHEN 0 THEN 'skill' WHEN 1 THEN 'subagent' WHEN 2 THEN 'command'
         WHEN 3 THEN 'mcp_tool' WHEN 4 THEN 'mcp_server' END AS kind, 'p' || p_partkey || 'g' || g AS name,
         count(l_partkey) AS invocations, count(*) FILTER (l_returnflag = 'R') AS failures,
         count(*) FILTER (l_partkey IS NOT NULL AND l_returnflag NOT IN ('R', 'A')) AS unknown, max(l_shipdate) AS last_used
  FROM (SELECT p_partkey, unnest(range({GROUPS})) AS g FROM part) LEFT JOIN lineitem ON l_partkey = p_partkey AND l_suppkey % {GROUPS} = g
  WHERE p_partkey % 6 <> 5 GROUP BY p_partkey, g)"""


@query("catalog_usage", f"""WITH {_SOLD} SELECT harness, kind, name, invocations, failures, unknown, last_used FROM sold
ORDER BY invocations DESC, harness, kind, name""")
def _(spark, tables):
    return order_snapshot(sold(tables))


@query("used_primitives", f"""WITH {_SOLD}
SELECT name, replace(kind, '_', ' ') AS kind, harness, strftime(last_used, '%Y-%m-%dT%H:%M:%SZ') AS last_used, invocations AS calls,
       failures, failures / nullif(invocations - unknown, 0) * 100 AS error_percent,
       CASE WHEN failures = 0 THEN '0' ELSE failures || ' (' || printf('%.1f', failures / (invocations - unknown) * 100) || '%)' END AS errors
FROM sold WHERE invocations > 0""")
def _(spark, tables):
    return used_primitives(sold(tables))


@query("unused_primitives", f"WITH {_SOLD} SELECT name, replace(kind, '_', ' ') AS kind, harness FROM sold WHERE invocations = 0")
def _(spark, tables):
    return unused_primitives(sold(tables))


@query("unused_overview", f"""WITH {_SOLD}, unused AS (
  SELECT upper(kind[1]) || replace(kind[2:], '_', ' ') AS label FROM sold WHERE invocations = 0)
SELECT CAST(0 AS TINYINT) AS is_total, label, count(*) AS unused FROM unused GROUP BY label
UNION ALL SELECT CAST(1 AS TINYINT), 'Total unused', count(*) FROM unused HAVING count(*) > 0""")
def _(spark, tables):
    return unused_overview(sold(tables))


@query("mcp_server_rollup", """
SELECT 'shop' AS harness, 'mcp_server' AS kind, 'n' || s_nationkey AS name, count(*) AS invocations,
       count(*) FILTER (l_returnflag = 'R') AS failures, count(*) FILTER (l_returnflag NOT IN ('R', 'A')) AS unknown, max(l_shipdate) AS last_used
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey""")
def _(spark, tables):
    joined = tables("lineitem").join(tables("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    outcome = F.when(F.col("l_returnflag") == "R", "error").when(F.col("l_returnflag") == "A", "ok")
    usage = joined.select(
        F.lit("shop").alias("harness"), F.lit("mcp_tool").alias("kind"),
        F.concat(F.lit("mcp__n"), "s_nationkey", F.lit("__s"), "s_suppkey").alias("name"),
        F.col("l_shipdate").alias("ts"), outcome.alias("outcome"),
    ).groupBy("harness", "kind", "name").agg(
        F.count(F.lit(1)).alias("invocations"), F.count_if(is_failure(F.col("outcome"))).alias("failures"),
        F.count_if(F.col("outcome").isNull()).alias("unknown"), F.max("ts").alias("last_used"))
    return mcp_servers_of_tools(usage)


@query("snapshot_publish", f"WITH {_SOLD} SELECT harness, kind, name, invocations, failures, unknown, last_used FROM sold")
def _(spark, tables):
    snapshots = UsageSnapshots(spark, scratch_path(spark, "snapshot"))
    snapshots.publish(sold(tables).limit(0))
    snapshots.refresh(sales_facts(tables("lineitem")), part_catalog(tables("part")), scanned=True)
    return snapshots.read().drop("version", "refreshed_at")


@query("catalog_carry_forward", """
SELECT DISTINCT 'shop' AS harness, CASE k % 6 WHEN 0 THEN 'skill' WHEN 1 THEN 'subagent' WHEN 2 THEN 'command'
       WHEN 3 THEN 'mcp_tool' WHEN 4 THEN 'mcp_server' ELSE 'builtin_tool' END AS kind, 'p' || k || 'g' || g AS name
FROM (SELECT p_partkey AS k FROM part WHERE p_size < 30 UNION ALL SELECT p_partkey FROM part WHERE p_size >= 20),
     (SELECT unnest(range(25)) AS g)""")
def _(spark, tables):
    part = tables("part")
    return carry_forward(part_catalog(part.where("p_size < 30")), False, part_catalog(part.where("p_size >= 20")))


_LAYOUT = r"""p AS (
  SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, page_id % 6 AS m FROM pages)"""


@query("catalog_layout", rf"""WITH {_LAYOUT}
SELECT '/' || host AS base, CASE m WHEN 0 THEN 'skill' WHEN 1 THEN 'subagent' ELSE 'command' END AS kind, 'n' || page_id AS name
FROM p WHERE m < 3 AND length(host) % 4 <> 0""")
def _(spark, tables):
    n, m = F.col("page_id"), F.col("page_id") % 6
    host = F.concat(F.lit("/"), F.regexp_extract("url", r"^https?://([^/?#]+)", 1))
    name = F.concat(F.lit("n"), n)
    files = tables("pages").select(
        host.alias("host"),
        F.when(m == 0, F.concat(host, F.lit("/skills/"), name, F.lit("/SKILL.md")))
        .when(m == 1, F.concat(host, F.lit("/agents/"), name, F.lit(".md")))
        .when(m == 2, F.concat(host, F.lit("/commands/"), name, F.lit(".md")))
        .when(m == 3, F.concat(host, F.lit("/skills/"), name, F.lit("/deep/SKILL.md")))
        .when(m == 4, F.concat(host, F.lit("/agents/sub/"), name, F.lit(".md")))
        .otherwise(F.concat(host, F.lit("/notes/"), name, F.lit(".md"))).alias("path"),
    )
    bases = files.where((F.length("host") - 1) % 4 != 0).select(F.col("host").alias("base"))
    return primitives_in_layout(files, bases).select("base", "kind", "name")


@query("mcp_configuration", """
SELECT DISTINCT 'mcp_server' AS kind, unnest(CASE WHEN c_custkey % 9 = 0 THEN [] ELSE
       ['cust-' || (c_custkey // 2), 'seg-' || lower(c_mktsegment)] END) AS name FROM customer""")
def _(spark, tables):
    n = F.col("c_custkey")
    doc = F.concat(
        F.lit('{"theme":"x","mcpServers":{"cust-'), F.floor(n / 2), F.lit('":{"command":["run"]},"seg-'),
        F.lower("c_mktsegment"), F.lit('":{}}'), F.when(n % 9 == 0, "").otherwise("}"),
    )
    return mcp_servers(tables("customer").select(doc.alias("value"))).distinct()


@query("plugin_manifests", """
SELECT DISTINCT '/plugins/' || s_nationkey || '/' || v AS base FROM supplier, (VALUES ('a'), ('b')) AS t(v)
WHERE s_suppkey % 7 <> 0 AND s_suppkey % 11 <> 0""")
def _(spark, tables):
    n = F.col("s_suppkey")
    path = F.concat(F.lit("/plugins/"), "s_nationkey", F.lit("/"))
    doc = F.concat(
        F.lit('{"plugins":{"one":[{"installPath":"'), path, F.lit('a"},{"installPath":""}],"two":[{"installPath":'),
        F.when(n % 7 == 0, F.lit("5")).otherwise(F.concat(F.lit('"'), path, F.lit('b"'))),
        F.lit("}]"), F.when(n % 11 == 0, F.lit(',"three":"text"')).otherwise(F.lit("")), F.lit("}}"),
    )
    return plugin_paths(tables("supplier").select(F.col("s_name").alias("path"), doc.alias("value")))


_LISTINGS_SQL = r"""WITH c AS (SELECT *, conv_id * 100 + turn AS n FROM conversations), w AS (
  SELECT n, unnest(list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda x: x <> '')) AS word FROM c WHERE n % 5 < 4)
SELECT DISTINCT CASE n % 3 WHEN 0 THEN 'skill' WHEN 1 THEN 'subagent' ELSE 'mcp_server' END AS kind, word AS name
FROM w WHERE n % 5 < 3 AND word <> ''"""


def _listing_lines(conversations: DataFrame) -> DataFrame:
    n, words = F.col("conv_id") * 100 + F.col("turn"), F.col("words")
    conversations = conversations.withColumn(
        "words", F.filter(F.split(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), " "), lambda w: w != ""))
    listing = F.concat(F.lit("Available:\n"), F.array_join(F.transform(words, lambda w: F.concat(F.lit("- "), w, F.lit(": does it"))), "\n"))
    cwd = F.when(n % 5 < 2, "/repo/a").when(n % 5 == 2, "/repo").when(n % 5 == 3, "/repository").otherwise("/repo")
    kind = F.when(n % 3 == 0, "skill_listing").when(n % 3 == 1, "agent_listing_delta").otherwise("mcp_instructions_delta")
    line = F.to_json(F.struct(cwd.alias("cwd"), F.struct(
        F.when(n % 5 == 4, F.lit("other")).otherwise(kind).alias("type"), listing.alias("content"),
        F.when(n % 3 == 1, words).alias("addedTypes"), F.when(n % 3 == 2, words).alias("addedNames")).alias("attachment")))
    return conversations.select(F.lit("c").alias("file"), F.lit(0).alias("chunk"), n.alias("line"),
                                F.lit(0).alias("nbytes"), line.alias("value"))


@query("session_listings", _LISTINGS_SQL)
def _(spark, tables):
    return listed_primitives(frame(_listing_lines(tables("conversations"))), spark.createDataFrame([("/repo",)], "root string"))


@query("announced_in_decode", _LISTINGS_SQL)
def _(spark, tables):
    """The same names as a second output of the one decode that also gives the entries."""
    entries = materialize(decode_entries(frame(_listing_lines(tables("conversations"))), announced=True), "entries")
    return announced_primitives(entries.select(F.inline("announced")), spark.createDataFrame([("/repo",)], "root string"))


@query("catalog_union", rf"""WITH {_LAYOUT}, found AS (
  SELECT CASE m WHEN 0 THEN 'skill' WHEN 1 THEN 'subagent' WHEN 2 THEN 'command' ELSE 'mcp_server' END AS kind, 'n' || (page_id % 50) AS name FROM p
  UNION ALL SELECT 'skill', 'n' || (p_partkey % 90) FROM part UNION ALL SELECT 'mcp_server', lower(c_mktsegment) FROM customer)
SELECT DISTINCT 'claude-code' AS harness, kind, name FROM found ORDER BY kind || ':' || name""")
def _(spark, tables):
    m = F.col("page_id") % 6
    pages = tables("pages").select(
        F.when(m == 0, "skill").when(m == 1, "subagent").when(m == 2, "command").otherwise("mcp_server").alias("kind"),
        F.concat(F.lit("n"), F.col("page_id") % 50).alias("name"))
    part = tables("part").select(F.lit("skill").alias("kind"), F.concat(F.lit(" n"), F.col("p_partkey") % 90).alias("name"))
    # Absolute paths are refused names and leave no row.
    refused = tables("pages").select(F.lit("skill").alias("kind"), F.concat(F.lit("/"), "url").alias("name"))
    servers = tables("customer").select(F.lit("mcp_server").alias("kind"), F.lower("c_mktsegment").alias("name"))
    return order_catalog(catalog([pages, part, refused, servers], NAME_KEY))


@query("discovery_report", rf"""WITH {_LAYOUT}, found AS (
  SELECT CASE m WHEN 0 THEN 'skill' WHEN 1 THEN 'subagent' ELSE 'command' END AS kind, 'n' || page_id AS name FROM p WHERE m < 3
  UNION SELECT 'mcp_server', 'seg-' || lower(c_mktsegment) FROM customer
  UNION SELECT 'skill', 'turn-' || role || (turn % 10) FROM conversations WHERE conv_id % 3 <> 2
), used AS (
  SELECT f.kind, f.name, count(l_partkey) AS calls FROM found f LEFT JOIN lineitem ON f.name = 'n' || l_partkey
    AND f.kind = CASE l_partkey % 6 WHEN 0 THEN 'skill' WHEN 1 THEN 'subagent' WHEN 2 THEN 'command' ELSE 'mcp_tool' END
  GROUP BY ALL)
SELECT 'used' AS section, replace(kind, '_', ' ') AS kind, name, calls FROM used WHERE calls > 0
UNION ALL SELECT 'unused', replace(kind, '_', ' '), name, NULL FROM used WHERE calls = 0
UNION ALL SELECT 'unused by kind', upper(kind[1]) || replace(kind[2:], '_', ' '), NULL, count(*) FROM used WHERE calls = 0 GROUP BY kind
UNION ALL SELECT 'unused by kind', 'Total unused', NULL, count(*) FROM used WHERE calls = 0 HAVING count(*) > 0""")
def _(spark, tables):
    """From layout, configuration, session listings and facts to the tables of a report."""
    n, m = F.col("page_id"), F.col("page_id") % 6
    base = F.concat(F.lit("/"), F.regexp_extract("url", r"^https?://([^/?#]+)", 1))
    folder = F.when(m == 0, "/skills/n").when(m == 1, "/agents/n").when(m == 2, "/commands/n").otherwise("/notes/n")
    files = tables("pages").select(
        base.alias("base"), F.concat(base, folder, n, F.when(m == 0, "/SKILL.md").otherwise(".md")).alias("path"))
    documents = tables("customer").select(
        F.concat(F.lit('{"mcpServers":{"seg-'), F.lower("c_mktsegment"), F.lit('":{}}}')).alias("value"))
    cwd = F.when(F.col("conv_id") % 3 == 2, "/other").otherwise("/repo/a")
    listing = F.concat(F.lit("- turn-"), "role", F.col("turn") % 10, F.lit(": listed"))
    line = F.to_json(F.struct(cwd.alias("cwd"), F.struct(F.lit("skill_listing").alias("type"), listing.alias("content")).alias("attachment")))
    lines = frame(tables("conversations").select(
        F.lit("c").alias("file"), F.lit(0).alias("chunk"), F.col("turn").alias("line"), F.lit(0).alias("nbytes"), line.alias("value")))
    found = primitives_of(files, files, documents, listed_primitives(lines, spark.createDataFrame([("/repo",)], "root string")), NAME_KEY, "shop")
    kind = F.col("l_partkey") % 6
    made = {
        "ts": F.col("l_shipdate"), "harness": F.lit("shop"), "session_id": F.concat(F.lit("o"), "l_orderkey"),
        "kind": F.when(kind == 0, "skill").when(kind == 1, "subagent").when(kind == 2, "command").otherwise("mcp_tool"),
        "name": F.concat(F.lit("n"), "l_partkey"), "outcome": F.lit("ok"),
    }
    facts = tables("lineitem").select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in INVOCATION.fields])
    tables_of = report_of(facts, materialize(catalog_usage(found, usage_by_primitive(facts)), "snapshot"))
    no_name, no_calls = F.lit(None).cast("string").alias("name"), F.lit(None).cast("bigint").alias("calls")
    return (
        tables_of.used.select(F.lit("used").alias("section"), "kind", "name", "calls")
        .unionByName(tables_of.unused.select(F.lit("unused").alias("section"), "kind", "name", no_calls))
        .unionByName(tables_of.unused_by_kind.select(
            F.lit("unused by kind").alias("section"), F.col("label").alias("kind"), no_name, F.col("unused").alias("calls")))
    )
