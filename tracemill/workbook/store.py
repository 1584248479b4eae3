"""Line items as a stream of records with natural repeats: store semantics at table scale."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions.digests import event_key
from tracemill.operators.validation import first_copies, unseen, validate
from tracemill.plans.health import ScanHealth
from tracemill.plans.store import EventStore, record_differences
from tracemill.schemas import COUNTER_NAMES, INVOCATION
from tracemill.session import lazy, materialize, scratch_path
from tracemill.sources.event_lines import decode_records
from tracemill.workbook.facts import FACTS, event_facts
from tracemill.workbook.registry import query


def line_facts(lineitem: DataFrame) -> DataFrame:
    """One record per line item; a repeated (order, line number) is a copy of one event."""
    made = {
        "schema_version": F.lit(1),
        "event_id": event_key(F.lit("shop"), F.concat("l_orderkey", F.lit("-"), "l_linenumber")),
        "ts": F.col("l_shipdate"), "harness": F.lit("shop"),
        "session_id": F.concat(F.lit("o"), "l_orderkey"), "repo": F.md5(F.col("l_suppkey").cast("string")),
        "kind": F.lit("skill"),
        # Every thirteenth part has a name no record may carry.
        "name": F.when(F.col("l_partkey") % 13 == 0, F.concat(F.lit("a/"), "l_partkey")).otherwise(F.concat(F.lit("p"), "l_partkey")),
        "invoker": F.lit("user"),
    }
    return lineitem.select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in INVOCATION.fields])


def valid_facts(lineitem: DataFrame) -> DataFrame:
    return validate(line_facts(lineitem)).where("invalid_reason is null").drop("invalid_reason")


_LINES = """lines AS (
  SELECT sha256('shop' || chr(0) || l_orderkey || '-' || l_linenumber) AS event_id, l_shipdate AS ts, 'o' || l_orderkey AS session_id,
         md5(CAST(l_suppkey AS VARCHAR)) AS repo, 'p' || l_partkey AS name, l_partkey % 13 = 0 AS bad, l_shipdate < TIMESTAMP '1998-01-01' AS early
  FROM lineitem), kept AS (
  SELECT * FROM lines WHERE NOT bad QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts, session_id, repo, name) = 1)"""


@query("first_copies", f"WITH {_LINES} SELECT event_id, ts, session_id, repo, name FROM kept")
def _(spark, tables):
    return first_copies(valid_facts(tables("lineitem")), ["ts"]).select("event_id", "ts", "session_id", "repo", "name")


@query("store_dedup", f"""WITH {_LINES}, later AS (
  SELECT * FROM lines WHERE NOT bad AND NOT early QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts, session_id, repo, name) = 1)
SELECT event_id, ts, session_id, repo, name FROM later WHERE event_id NOT IN (SELECT event_id FROM lines WHERE early AND NOT bad)""")
def _(spark, tables):
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    rows = tables("lineitem")
    stored = valid_facts(rows.where(F.col("l_shipdate") < cut)).select("event_id")
    batch = first_copies(valid_facts(rows.where(F.col("l_shipdate") >= cut)), ["ts"])
    return unseen(batch, stored).select("event_id", "ts", "session_id", "repo", "name")


@query("idempotent_append", f"""WITH {_LINES}
SELECT 1 AS step, (SELECT count(DISTINCT event_id) FROM lines WHERE early AND NOT bad) AS written,
       (SELECT count(*) - count(DISTINCT event_id) FROM lines WHERE early AND NOT bad) AS duplicate,
       (SELECT count(*) FROM lines WHERE early AND bad) AS dropped
UNION ALL
SELECT 2, (SELECT count(*) FROM kept WHERE NOT early),
       (SELECT count(*) FROM lines WHERE NOT bad) - (SELECT count(*) FROM kept WHERE NOT early), (SELECT count(*) FROM lines WHERE bad)
UNION ALL
SELECT 3, 0, (SELECT count(*) FROM lines WHERE NOT bad), (SELECT count(*) FROM lines WHERE bad)""")
def _(spark, tables):
    store = EventStore(spark, scratch_path(spark, "store"))
    lineitem = tables("lineitem")
    everything = line_facts(lineitem)
    steps = [line_facts(lineitem.where(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz"))), everything, everything]
    results = [store.append(rows, stage=lazy) for rows in steps]
    rows = [(i + 1, r.written, r.duplicate, r.dropped) for i, r in enumerate(results)]
    return spark.createDataFrame(rows, "step int, written bigint, duplicate bigint, dropped bigint")


@query("append_by_size", f"""WITH {_LINES}, shares AS (SELECT unnest([16, 4, 1]) AS share), orders_of AS (
  SELECT share, event_id, bad, CAST(substr(session_id, 2) AS BIGINT) % share = 0 AS held, CAST(substr(session_id, 2) AS BIGINT) % 64 AS rest FROM lines, shares)
SELECT share, count(DISTINCT CASE WHEN held AND NOT bad THEN event_id END) AS stored,
       count(DISTINCT CASE WHEN rest IN (0, 1) AND NOT held AND NOT bad THEN event_id END) AS written,
       count(*) FILTER (rest IN (0, 1) AND NOT bad) - count(DISTINCT CASE WHEN rest IN (0, 1) AND NOT held AND NOT bad THEN event_id END) AS duplicate
FROM orders_of GROUP BY share""")
def _(spark, tables):
    """The same batch into stores of one, four and sixteen shares of the orders: ids are looked up, not read."""
    lineitem, rows = tables("lineitem"), []
    for share in (16, 4, 1):
        store = EventStore(spark, scratch_path(spark, "store"))
        held = store.append(line_facts(lineitem.where(F.col("l_orderkey") % share == 0))).written
        result = store.append(line_facts(lineitem.where(F.col("l_orderkey") % 64 < 2)))
        rows.append((share, held, result.written, result.duplicate))
    return spark.createDataFrame(rows, "share int, stored bigint, written bigint, duplicate bigint")


@query("rebuild_equivalence", f"""WITH {_LINES}
SELECT (SELECT count(*) FROM kept) AS stored, 0::BIGINT AS differences""")
def _(spark, tables):
    rows = line_facts(tables("lineitem"))
    rebuilt, fresh = EventStore(spark, scratch_path(spark, "rebuilt")), EventStore(spark, scratch_path(spark, "fresh"))
    rebuilt.append(line_facts(tables("lineitem").where("l_linenumber = 1")), stage=lazy)
    rebuilt.rebuild(rows, stage=lazy)
    fresh.append(rows, stage=lazy)
    differences = record_differences(rebuilt.read(), fresh.read()).groupBy().agg(F.count(F.lit(1)).alias("differences"))
    stored = rebuilt.read().groupBy().agg(F.count(F.lit(1)).alias("stored"))
    return stored.unionByName(differences, allowMissingColumns=True).agg(
        F.max("stored").alias("stored"), F.max("differences").alias("differences"))


@query("store_scan", f"""WITH {FACTS}
SELECT event_id, ts, position FROM (
  SELECT event_id, ts, row_number() OVER (ORDER BY batch, ts, event_id) AS position FROM (
    SELECT f.event_id, f.ts, CASE WHEN f.ts < TIMESTAMP '2024-01-20' THEN 0 ELSE 1 END AS batch FROM facts f))
WHERE position > 100""")
def _(spark, tables):
    store = EventStore(spark, scratch_path(spark, "store"))
    facts = event_facts(tables("events"))
    store.append(facts.where(F.col("ts") < F.lit("2024-01-20").cast("timestamp")))
    store.append(facts)
    return store.entries(after=100).select("event_id", "ts", "position")


@query("record_lines", f"""WITH {FACTS}
SELECT f.event_id, f.kind, f.name FROM facts f WHERE f.event_id NOT IN (
  SELECT sha256('events' || chr(0) || event_id) FROM events WHERE event_id % 9 = 0 OR event_id % 10 = 0)""")
def _(spark, tables):
    events = tables("events")
    numbers = events.select(event_key(F.lit("events"), F.col("event_id").cast("string")).alias("event_id"), F.col("event_id").alias("n"))
    facts = event_facts(events).withColumn("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    text = F.to_json(F.struct(*[c for c in facts.columns]))
    spoiled = F.when(F.col("n") % 9 == 0, F.substr(text, F.lit(1), F.length(text) - 1)).when(
        F.col("n") % 10 == 0, F.replace(text, F.lit('"schema_version":1'), F.lit('"schema_version":"1"'))).otherwise(text)
    lines = facts.join(numbers, "event_id").select(
        F.lit("f").alias("file"), F.lit(0).alias("chunk"), F.col("n").alias("line"), spoiled.alias("value"))
    return decode_records(lines).select("event_id", "kind", "name")


@query("scan_counter_table", """
SELECT 'collects nothing' AS state, TIMESTAMP '2024-02-02 00:00:00' AS scan_at, count(*) AS transcripts,
       count(*) FILTER (event_type = 'error') AS parse_errors, count(*) FILTER (event_type = 'view') AS events_written FROM events""")
def _(spark, tables):
    health = ScanHealth(spark, scratch_path(spark, "health"))
    events = tables("events")
    given = {"transcripts": F.count(F.lit(1)), "parse_errors": F.count_if(F.col("event_type") == "error"),
             "events_written": F.count_if(F.col("event_type") == "view")}
    totals = materialize(events.agg(*[given.get(n, F.sum(F.lit(0))).alias(n) for n in COUNTER_NAMES]), "counters")
    health.record_scan(totals.withColumn("parse_errors", F.lit(0)), datetime(2024, 2, 1, tzinfo=timezone.utc))
    health.record_scan(totals, datetime(2024, 2, 2, tzinfo=timezone.utc))
    return health.diagnose().select("state", "scan_at", "transcripts", "parse_errors", "events_written")
