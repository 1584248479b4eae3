"""Orders as calls and line items as their results: pairing and closing at table scale."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.operators.pairing import call_events, first_results, pair_calls
from tracemill.operators.sessions import (
    Staleness,
    blind_files,
    closed_sessions,
    cursor_floor,
    session_activity,
    with_closed_flag,
    with_line_offsets,
)
from tracemill.operators.skills import collapse_candidates, uncovered_runs
from tracemill.session import materialize
from tracemill.sources.lines import frame
from tracemill.workbook.registry import query

NOW = datetime(2001, 9, 15, tzinfo=timezone.utc)
QUIET = Staleness(timedelta(days=45), NOW)

# A result is placed by ship date, then by the rest of its key.
RESULT_KEY = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
_OUTCOME = "CASE l_returnflag WHEN 'R' THEN 'error' WHEN 'A' THEN 'ok' END"


def _day(column: str):
    return F.unix_date(F.col(column).cast("date")).cast("bigint")


def _flag_outcome():
    return F.when(F.col("l_returnflag") == "R", "error").when(F.col("l_returnflag") == "A", "ok")


def order_events(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    uses = orders.select(
        F.lit("orders").alias("file"),
        F.col("o_orderkey").cast("string").alias("call_id"),
        _day("o_orderdate").alias("chunk"),
        F.lit(-1).cast("bigint").alias("line"),
        F.lit(0).alias("block"),
        F.lit("accepted").alias("status"),
        F.struct(
            F.col("o_orderkey").alias("order"),
            F.col("o_custkey").cast("string").alias("session_id"),
            F.col("o_orderdate").cast("timestamp").alias("ts"),
        ).alias("call"),
    )
    results = lineitem.select(
        F.lit("orders").alias("file"),
        F.col("l_orderkey").cast("string").alias("call_id"),
        _day("l_shipdate").alias("chunk"),
        (F.shiftleft(F.col("l_linenumber").cast("bigint"), 40) + F.col("l_partkey")).alias("line"),
        F.col("l_suppkey").cast("int").alias("block"),
        F.struct(F.col("l_shipdate").cast("timestamp").alias("ts"), _flag_outcome().alias("outcome")).alias("result"),
    )
    return call_events(uses, results)


_FIRST = f"""first AS (
  SELECT l_orderkey, l_shipdate AS ts, {_OUTCOME} AS outcome FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(RESULT_KEY)}) = 1)"""


@query("first_results", f"WITH {_FIRST} SELECT l_orderkey, ts, outcome FROM first")
def _(spark, tables):
    results = tables("lineitem").select(
        "l_orderkey", *RESULT_KEY, F.col("l_shipdate").alias("ts"), _flag_outcome().alias("outcome")
    )
    return first_results(results, ["l_orderkey"], RESULT_KEY).select("l_orderkey", "ts", "outcome")


@query("call_result_pairing", f"""WITH {_FIRST}
SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS session_id, o_orderdate AS called_at, f.ts AS finished_at, f.outcome,
       f.l_orderkey IS NULL AS is_open
FROM orders LEFT JOIN first f ON o_orderkey = l_orderkey""")
def _(spark, tables):
    pairs = pair_calls(order_events(tables("orders"), tables("lineitem")), materialize)
    return pairs.select(
        F.col("call.order").alias("o_orderkey"), F.col("call.session_id").alias("session_id"),
        F.col("call.ts").alias("called_at"), F.col("result.ts").alias("finished_at"),
        F.col("result.outcome").alias("outcome"), F.col("result").isNull().alias("is_open"),
    )


# One id per customer, used by all of its orders: every order is a call of that id, an
# order in status P is a refused one, and each line item is a result.
_REUSED_SQL = """WITH RECURSIVE ev AS (
  SELECT cust, tag, oid, outcome, row_number() OVER (PARTITION BY cust ORDER BY day, kind, a, b) AS rn FROM (
    SELECT o_custkey AS cust, CASE WHEN o_orderstatus = 'P' THEN 'void' ELSE 'use' END AS tag, o_orderkey AS oid,
           NULL AS outcome, o_orderdate AS day, 0 AS kind, o_orderkey AS a, 0 AS b FROM orders
    UNION ALL
    SELECT o_custkey, 'result', l_orderkey, CASE l_returnflag WHEN 'R' THEN 'error' WHEN 'A' THEN 'ok' ELSE 'unknown' END,
           l_shipdate, 1, l_orderkey * 8 + l_linenumber, l_partkey * 100000 + l_suppkey
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
), walk AS (
  SELECT cust, 0::BIGINT AS rn, 'idle' AS state, NULL::BIGINT AS held, NULL::VARCHAR AS early,
         NULL::BIGINT AS call_order, NULL::VARCHAR AS outcome FROM (SELECT DISTINCT cust FROM ev)
  UNION ALL
  SELECT e.cust, e.rn,
    CASE WHEN e.tag = 'use' THEN CASE w.state WHEN 'early' THEN 'idle' ELSE 'waiting' END
         WHEN e.tag = 'void' THEN CASE w.state WHEN 'early' THEN 'idle' ELSE w.state END
         ELSE CASE w.state WHEN 'waiting' THEN 'idle' ELSE 'early' END END,
    CASE WHEN e.tag = 'use' THEN CASE w.state WHEN 'early' THEN NULL ELSE e.oid END
         WHEN e.tag = 'result' THEN NULL ELSE w.held END,
    CASE WHEN e.tag = 'result' AND w.state = 'idle' THEN e.outcome
         WHEN e.tag = 'result' AND w.state = 'early' THEN w.early ELSE NULL END,
    CASE WHEN e.tag = 'use' AND w.state = 'early' THEN e.oid
         WHEN e.tag = 'result' AND w.state = 'waiting' THEN w.held END,
    CASE WHEN e.tag = 'use' AND w.state = 'early' THEN w.early
         WHEN e.tag = 'result' AND w.state = 'waiting' THEN e.outcome END
  FROM walk w JOIN ev e ON e.cust = w.cust AND e.rn = w.rn + 1
)
SELECT cust AS customer, call_order, outcome, false AS is_open FROM walk WHERE call_order IS NOT NULL
UNION ALL
SELECT cust, held, NULL, true FROM walk JOIN (SELECT cust, max(rn) AS rn FROM ev GROUP BY cust) USING (cust, rn)
WHERE state = 'waiting'"""


@query("reused_call_ids", _REUSED_SQL)
def _(spark, tables):
    orders, lineitem = tables("orders"), tables("lineitem")

    def place(day: str, low):
        # Quarters are the chunks; inside one, days come first.
        return [F.expr(f"{day} div 90").alias("chunk"), (F.shiftleft(F.col(day) % 90, 44) + low).alias("line")]

    uses = orders.withColumn("day", _day("o_orderdate")).select(
        F.lit("customers").alias("file"), F.col("o_custkey").cast("string").alias("call_id"),
        *place("day", F.col("o_orderkey")), F.lit(0).alias("block"),
        F.when(F.col("o_orderstatus") == "P", "refused").otherwise("accepted").alias("status"),
        F.struct(F.col("o_orderkey").alias("order")).alias("call"),
    )
    shipped = lineitem.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    results = shipped.withColumn("day", _day("l_shipdate")).select(
        F.lit("customers").alias("file"), F.col("o_custkey").cast("string").alias("call_id"),
        *place("day", F.lit(1 << 43) + F.col("l_orderkey") * 8 + F.col("l_linenumber")),
        F.col("l_partkey").cast("int").alias("block"),
        F.struct(F.coalesce(_flag_outcome(), F.lit("unknown")).alias("outcome")).alias("result"),
    )
    # Read once to count the events of each id and once to fold them.
    pairs = pair_calls(materialize(call_events(uses, results), "call-events"), materialize)
    return pairs.select(
        F.col("call_id").cast("bigint").alias("customer"), F.col("call.order").alias("call_order"),
        F.col("result.outcome").alias("outcome"), F.col("result").isNull().alias("is_open"),
    )


def order_activity(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Lines of 16 files: each order and each line item proves activity of its customer."""
    placed = orders.select(
        "o_custkey", "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("seen_ts"),
        (F.col("o_orderkey") * 100).alias("offset"),
    )
    shipped = lineitem.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        "o_custkey", "o_orderkey", F.col("l_shipdate").cast("timestamp").alias("seen_ts"),
        (F.col("o_orderkey") * 100 + F.col("l_linenumber")).alias("offset"),
    )
    both = placed.unionByName(shipped)
    return both.select(
        F.concat(F.lit("f"), F.col("o_custkey") % 16).alias("file"),
        F.col("o_custkey").cast("string").alias("seen_session"),
        "seen_ts",
        "offset",
        ((F.col("o_custkey") % 16 == 5) & (F.col("o_orderkey") % 50 == 0)).alias("blind"),
    )


_ACTIVITY = """activity AS (
  SELECT 'f' || (o_custkey % 16) AS file, CAST(o_custkey AS VARCHAR) AS session, max(seen) AS last_activity, min(off) AS first_offset
  FROM (SELECT o_custkey, o_orderdate AS seen, o_orderkey * 100 AS off FROM orders
        UNION ALL SELECT o_custkey, l_shipdate, o_orderkey * 100 + l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
  GROUP BY 1, 2
), blind AS (SELECT DISTINCT 'f' || (o_custkey % 16) AS file FROM orders WHERE o_custkey % 16 = 5 AND o_orderkey % 50 = 0
), closed AS (SELECT file, session FROM activity
  WHERE last_activity < TIMESTAMP '2001-09-15' - INTERVAL 45 DAY AND file NOT IN (SELECT file FROM blind))"""


@query("session_activity", f"WITH {_ACTIVITY} SELECT file, session, last_activity FROM activity")
def _(spark, tables):
    return session_activity(order_activity(tables("orders"), tables("lineitem")))


@query("cursor_floors", f"""WITH {_ACTIVITY}
SELECT f.file, count(a.session) AS open_sessions, coalesce(min(a.first_offset), 0) AS cursor_floor
FROM (SELECT DISTINCT file FROM activity) f LEFT JOIN (
  SELECT * FROM activity WHERE (file, session) NOT IN (SELECT file, session FROM closed)) a ON a.file = f.file
GROUP BY f.file""")
def _(spark, tables):
    lines = order_activity(tables("orders"), tables("lineitem"))
    activity = lines.groupBy("file", F.col("seen_session").alias("session")).agg(
        F.max("seen_ts").alias("last_activity"), F.min("offset").alias("first_offset"))
    return cursor_floor(lines.select("file").distinct(), activity, blind_files(lines), QUIET)


@query("stale_calls", f"""WITH {_ACTIVITY}, {_FIRST}
SELECT o_orderkey, o_orderdate AS ts,
       CASE WHEN ('f' || (o_custkey % 16), CAST(o_custkey AS VARCHAR)) IN (SELECT (file, session) FROM closed)
            THEN 'interrupted' ELSE 'pending' END AS state
FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM first)""")
def _(spark, tables):
    orders, lineitem = tables("orders"), tables("lineitem")
    lines = order_activity(orders, lineitem)
    closed = closed_sessions(session_activity(lines), blind_files(lines), QUIET)
    pairs = pair_calls(order_events(orders, lineitem), materialize)
    waiting = pairs.where(F.col("result").isNull()).select(
        F.concat(F.lit("f"), F.col("call.session_id").cast("bigint") % 16).alias("file"),
        F.col("call.session_id").alias("session"), F.col("call.order").alias("o_orderkey"), F.col("call.ts").alias("ts"),
    )
    state = F.when(F.col("is_closed"), "interrupted").otherwise("pending")
    return with_closed_flag(waiting, closed).select("o_orderkey", "ts", state.alias("state"))


def _runs(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.concat(F.lit("f"), F.col("o_custkey") % 16).alias("file"), F.col("o_custkey").cast("string").alias("session"),
        F.lower(F.substr("o_orderpriority", F.lit(3))).alias("name"),
        F.struct(F.col("o_orderdate").cast("timestamp").alias("ts"),
                 F.sha2(F.col("o_orderkey").cast("string"), 256).alias("event_id"), "o_orderkey").alias("record"),
    )


_COLLAPSED = """runs AS (
  SELECT 'f' || (o_custkey % 16) AS file, CAST(o_custkey AS VARCHAR) AS session, lower(substr(o_orderpriority, 3)) AS name,
         first(o_orderkey ORDER BY o_orderdate, sha256(CAST(o_orderkey AS VARCHAR))) AS o_orderkey, count(*) - 1 AS extra
  FROM orders {where} GROUP BY 1, 2, 3)"""


#: Finished orders are calls by name; all others are turns that may show a run nobody called.
_NOT_INVOKED = "WHERE o_orderstatus <> 'F'"


@query("candidate_collapse", f"WITH {_COLLAPSED.format(where='')} SELECT file, session, name, o_orderkey, extra FROM runs")
def _(spark, tables):
    return collapse_candidates(_runs(tables("orders"))).select("file", "session", "name", "record.o_orderkey", "extra")


@query("uncovered_skill_runs", f"""WITH {_COLLAPSED.format(where=_NOT_INVOKED)}, {_ACTIVITY}
SELECT file, session, name, o_orderkey, extra FROM runs
WHERE (file, session) IN (SELECT file, session FROM closed)
  AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'F' AND CAST(o_custkey AS VARCHAR) = session
                  AND lower(substr(o_orderpriority, 3)) = name)""")
def _(spark, tables):
    orders = tables("orders")
    lines = order_activity(orders, tables("lineitem"))
    closed = closed_sessions(session_activity(lines), blind_files(lines), QUIET)
    invoked = orders.where("o_orderstatus = 'F'").select(
        F.concat(F.lit("f"), F.col("o_custkey") % 16).alias("file"), F.col("o_custkey").cast("string").alias("session"),
        F.lower(F.substr("o_orderpriority", F.lit(3))).alias("name"),
    )
    runs = uncovered_runs(collapse_candidates(_runs(orders.where("o_orderstatus <> 'F'"))), invoked, closed)
    return runs.select("file", "session", "name", "record.o_orderkey", "extra")


def document_lines(documents: DataFrame) -> DataFrame:
    """Each document as a file of lines, cut into chunks of 32 lines."""
    lines = documents.select(
        F.concat(F.lit("d"), "doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("line", "value")
    )
    return lines.select(
        "file", F.expr("cast(line div 32 as bigint)").alias("chunk"), F.col("line").cast("bigint").alias("line"),
        (F.octet_length("value") + 1).cast("bigint").alias("nbytes"), "value",
    )


_DOC_LINES = """raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS v, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents
), lines AS (SELECT *, strlen(v) + 1 AS nbytes, CASE WHEN ends_with(v, chr(13)) THEN left(v, length(v) - 1) ELSE v END AS t FROM raw)"""


@query("line_framing", f"""WITH {_DOC_LINES}
SELECT 'd' || doc_id AS file, count(*) AS lines, count(*) FILTER (strlen(t) > 200) AS oversize,
       count(*) FILTER (t = '') AS blank, CAST(sum(CASE WHEN strlen(t) <= 200 THEN strlen(t) ELSE 0 END) AS BIGINT) AS kept_bytes
FROM lines GROUP BY doc_id""")
def _(spark, tables):
    framed = frame(document_lines(tables("documents")), cap=200)
    return framed.groupBy("file").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if("oversize").alias("oversize"),
        F.count_if(F.col("value") == "").alias("blank"),
        F.coalesce(F.sum(F.octet_length("value").cast("bigint")), F.lit(0)).alias("kept_bytes"),
    )


@query("line_offsets", f"""WITH {_DOC_LINES}
SELECT 'd' || doc_id AS file, line, CAST(coalesce(sum(nbytes) OVER (PARTITION BY doc_id ORDER BY line
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM lines""")
def _(spark, tables):
    narrow = document_lines(tables("documents")).drop("value")
    return with_line_offsets(narrow).select("file", "line", "offset")
