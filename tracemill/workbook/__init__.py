"""Every operator run over the given tables, each with its SQL counterpart where one exists."""

from tracemill.workbook import catalog, consent, facts, pairing, store, streams, transcripts  # noqa: F401
from tracemill.workbook.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
