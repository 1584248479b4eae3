"""Small transcripts, one per file, run through the derivation together."""

from datetime import datetime, timedelta, timezone

from tracemill.operators.sessions import Staleness
from tracemill.plans.derive import DeriveOptions, derive, file_counters
from tracemill.session import materialize
from tracemill.sources.lines import feed_lines
from tracemill.sources.transcripts import decode_entries

REPO = "c0ffee00c0ffee00c0ffee00c0ffee00"
CALL_AT = datetime(2021, 5, 4, 9, 30, 0, tzinfo=timezone.utc)
HOUR = timedelta(hours=1)
CLOSED = Staleness(HOUR, CALL_AT + 8 * HOUR)
NO_RULE = Staleness()
NAME_KEY = b"key of the harbour"
SALT = b"test salt"

CONSENT_SCHEMA = (
    "entry int, id string, label string, root string, aliases array<string>, "
    "case_insensitive boolean, collect_from timestamp"
)


def consent_rows(spark, *rows):
    """rows: (id, root[, collect_from[, aliases[, fold]]])"""
    full = []
    for number, row in enumerate(rows):
        id_, root, from_, aliases, fold = (*row, *(None, None, None)[len(row) - 2:])
        full.append((number, id_, f"label{number}", root, aliases, bool(fold), from_))
    return spark.createDataFrame(full, CONSENT_SCHEMA)


def feed(spark, transcripts):
    """{file: [line, ...]} -> feed rows with true byte offsets."""
    rows = []
    for file, lines in transcripts.items():
        offset = 0
        for line in lines:
            rows.append((file, offset, line))
            offset += len(line.encode()) + 1
    return spark.createDataFrame(rows, "file string, offset bigint, value string")


class Run:
    def __init__(self, spark, transcripts, staleness=NO_RULE, consent=None, scope="history", cap=1024 * 1024,
                 name_key=NAME_KEY):
        consent = consent if consent is not None else consent_rows(spark, (REPO, "/repo"))
        self.entries = materialize(decode_entries(feed_lines(feed(spark, transcripts), cap)))
        options = DeriveOptions(SALT, name_key, staleness, scope)
        self.derived = derive(self.entries, consent, options, materialize)
        files = spark.createDataFrame([(f, 1) for f in transcripts], "file string, length bigint")
        self.counters = {r.file: r for r in file_counters(files, self.entries, self.derived).collect()}
        self.records = {f: [] for f in transcripts}
        for row in self.derived.records.orderBy("src_file", "src_phase", "src_pos", "ts", "event_id").collect():
            self.records[row.src_file].append(row)
