"""Keyed and unkeyed SHA-256 digests as column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def hmac_pads(key: bytes) -> tuple[bytes, bytes]:
    block = (hashlib.sha256(key).digest() if len(key) > _BLOCK else key).ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def hmac_hex(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 of ``message`` (string or binary) in lower-case hex, all JVM side.

    The two padded key blocks are folded into literals when the plan is built.
    """
    inner_pad, outer_pad = hmac_pads(key)
    inner = F.unhex(F.sha2(F.concat(F.lit(inner_pad), message.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(outer_pad), inner), 256)


def event_key(harness: Column, source_event: Column) -> Column:
    """Stable id of one event: no ordinal and no clock takes part, so re-reading repeats it."""
    return F.sha2(F.concat(harness, F.lit("\x00"), source_event), 256)


def call_event_key(harness: Column, entry_uuid: Column, block_id: Column) -> Column:
    return event_key(harness, F.concat(entry_uuid, F.lit("\x1f"), block_id))
