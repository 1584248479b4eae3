"""The bounded value domains a stored field may come from, as boolean/string columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill.functions.digests import hmac_hex

# The shape of each domain. A name or version never looks like a drive
# letter path.
NAME = r"(?![A-Za-z]:)[A-Za-z0-9][A-Za-z0-9._:@+-]{0,127}"
TOKEN = r"[A-Za-z0-9][A-Za-z0-9._-]{0,127}"
VERSION = r"(?![A-Za-z]:)[A-Za-z0-9][A-Za-z0-9._+:-]{0,127}"
HARNESS = r"(?=.{1,32}\z)[a-z0-9]+(?:-[a-z0-9]+)*"
DERIVED_SCOPE = r"scope-[0-9a-f]{12}:"
SHA256_HEX = r"[a-f0-9]{64}"
REPO_HEX = r"[a-f0-9]{32}"
MAX_IDENTIFIER = 128

# A path scope: two or more clean relative elements; then the name behind the first colon,
# short enough to follow "scope-<12 hex>:".
_ELEMENT = r"(?!\.{1,2}[/:])[^/:\\]+"
SCOPED_NAME = rf"((?!~){_ELEMENT}(?:/{_ELEMENT})+):([A-Za-z0-9._:@+-]{{1,109}})"

_SPACE = r"[\t\n\x0B\f\r\u0085\p{Z}]"


# Every pattern is anchored with \A and \z because $ would also accept a final newline.
# One expression trims, tests and extracts, so a value is matched once per row.
def _whole(pattern: str) -> str:
    return rf"\A{pattern}\z"


def _trimmed(pattern: str) -> str:
    return rf"\A{_SPACE}*+{pattern}{_SPACE}*\z"


def _bounded(value: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(value, _trimmed(f"({pattern})"), 1), F.lit(""))


def trim_space(value: Column) -> Column:
    """Strip Unicode white space from both ends (``trim`` only knows the ASCII blank)."""
    return F.regexp_replace(value, rf"\A{_SPACE}+|{_SPACE}+\z", "")


def is_name(value: Column) -> Column:
    return value.rlike(_whole(NAME))


def is_token(value: Column) -> Column:
    return value.rlike(_whole(TOKEN))


def is_version(value: Column) -> Column:
    return value.rlike(_whole(VERSION))


def is_harness(value: Column) -> Column:
    return value.rlike(_whole(HARNESS))


def is_event_id(value: Column) -> Column:
    return value.rlike(_whole(SHA256_HEX))


def is_repo(value: Column) -> Column:
    return value.rlike(_whole(REPO_HEX))


def bounded_name(value: Column) -> Column:
    """The trimmed value when it is a name, else NULL."""
    return _bounded(value, NAME)


def bounded_token(value: Column) -> Column:
    return _bounded(value, TOKEN)


def bounded_version(value: Column) -> Column:
    return _bounded(value, VERSION)


def derived_name(value: Column, key: bytes | None) -> Column:
    """Name of a primitive, with a path scope replaced by its keyed digest.

    ``apps/web:deploy`` becomes ``scope-<12 hex>:deploy``. NULL means refused; a value
    already shaped like a digest is refused, and so is any scope when there is no key.
    """
    plain = _bounded(value, rf"(?!{DERIVED_SCOPE}){NAME}")
    if not key:
        return F.when(~value.contains("/"), plain)
    pattern = _trimmed(rf"(?!{DERIVED_SCOPE}){SCOPED_NAME}")
    scope = F.regexp_extract(value, pattern, 1)
    name = F.regexp_extract(value, pattern, 2)
    digest = F.substr(hmac_hex(key, scope), F.lit(1), F.lit(12))
    fits = (scope != "") & (F.octet_length(scope) + F.octet_length(name) < MAX_IDENTIFIER)
    scoped = F.when(fits, F.concat(F.lit("scope-"), digest, F.lit(":"), name))
    return F.when(value.contains("/"), scoped).otherwise(plain)
