"""Read the consent table and keep only the entries that can be trusted."""

from __future__ import annotations

import hashlib
import hmac
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.digests import hmac_hex
from tracemill.functions.paths import clean_absolute
from tracemill.operators.consent import ambiguous_entries
from tracemill.schemas import CONSENT_VERSION
from tracemill.sources import typed_json as J

CANONICAL_INSTANT = r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{0,8}[1-9])?Z\z"
_TEXT = ["id", "label", "root", "collect_from", "match_mac"]
REPO_ID = r"\A[0-9a-f]{32}\z"


@dataclass(frozen=True)
class Signing:
    """The secret of one installation and the label its signatures start with.

    ``domain`` must be the label the writer of the table used.
    """

    salt: bytes
    domain: str = "tracemill/consent/v1"
    name_domain: str = "tracemill/names/v1"

    def name_key(self) -> bytes:
        """Key for scoped names, derived from the salt so that the two uses never meet."""
        return hmac.new(self.salt, self.name_domain.encode(), hashlib.sha256).digest()


def parse_consent(documents: DataFrame) -> DataFrame:
    """(path, value) documents -> one row per entry, in table order.

    The version of every document is checked first; an unknown one is refused, never
    upgraded. One document is one installation's table: a handful of entries. ``entry`` is
    (document, place in it), so the entries of several documents never meet.
    """
    doc = F.col("doc")
    entries = J.elements(doc, f"{J.ROOT}.projects")
    parsed = documents.select("path", J.parse(F.col("value")).alias("doc")).select(
        "path",
        J.integer(doc, f"{J.ROOT}.version").value.alias("version"),
        entries.fits.alias("fits"),
        F.coalesce(entries.value, F.array().cast("array<variant>")).alias("items"),
    )
    typed = F.forall("items", lambda item: J.all_fit(
        J.object_fits(item, "$"),
        *[J.string(item, f"$.{n}").fits for n in _TEXT],
        J.string_list(item, "$.aliases").fits,
        J.boolean(item, "$.case_insensitive").fits,
    ))
    usable = F.coalesce((F.col("version") == CONSENT_VERSION) & F.col("fits") & typed, F.lit(False))
    checked = parsed.withColumn(
        "items", F.when(usable, F.col("items")).otherwise(F.raise_error(F.lit("unusable consent table")))
    )
    item = F.col("item")
    aliases = J.string_list(item, "$.aliases")
    return checked.select("path", F.posexplode("items").alias("place", "item")).select(
        F.struct("path", "place").alias("entry"),
        *[
            F.coalesce(J.string(item, f"$.{n}").value, F.lit("")).alias(n)
            for n in _TEXT
        ],
        F.coalesce(aliases.value, F.array().cast("array<string>")).alias("aliases"),
        F.coalesce(J.boolean(item, "$.case_insensitive").value, F.lit(False)).alias("case_insensitive"),
    )


def _clean_root(path: Column) -> Column:
    return F.coalesce(clean_absolute(path) == path, F.lit(False))


def well_formed() -> Column:
    """Shape rules of one entry."""
    instant = F.try_to_timestamp(F.regexp_replace("collect_from", r"(\.\d{6})\d+", "$1"))
    zero = F.lit("0001-01-01T00:00:00Z").cast("timestamp")
    boundary = (F.col("collect_from") == "") | (
        F.col("collect_from").rlike(CANONICAL_INSTANT) & F.coalesce(instant != zero, F.lit(False))
    )
    return (
        F.col("id").rlike(REPO_ID)
        & (F.col("label") != "")
        & ~F.col("label").contains("/")
        & _clean_root(F.col("root"))
        & F.forall("aliases", _clean_root)
        & boundary
    )


def _signed_text(signing: Signing) -> Column:
    """What a signature covers up to the boundary: label, case flag and every spelling."""
    spellings = F.concat(F.array("root"), F.col("aliases"))
    return F.concat(
        F.lit(signing.domain + "\0"),
        F.when(F.col("case_insensitive"), F.lit("f")).otherwise(F.lit("")),
        F.lit("\0"),
        F.array_join(F.transform(spellings, lambda s: F.concat(s, F.lit("\0"))), ""),
    )


def signature(signing: Signing) -> Column:
    return hmac_hex(signing.salt, F.concat(_signed_text(signing), F.col("collect_from"), F.lit("\0")))


def boundless_signature(signing: Signing) -> Column:
    """The older form, which covers no boundary and so is accepted only where there is none."""
    return hmac_hex(signing.salt, _signed_text(signing))


def trusted_consent(entries: DataFrame, signing: Signing) -> DataFrame:
    """Every entry with ``verdict``: trusted, malformed, unsigned or ambiguous.

    An entry is believed when its id and its signature follow from the secret. Of entries
    that then share an id, a root or a spelling, none is kept.
    """
    own_id = F.substr(hmac_hex(signing.salt, F.col("root")), F.lit(1), F.lit(32)) == F.col("id")
    mac = (signature(signing) == F.col("match_mac")) | (
        (F.col("collect_from") == "") & (boundless_signature(signing) == F.col("match_mac"))
    )
    judged = entries.withColumn(
        "verdict",
        F.when(~well_formed(), F.lit("malformed")).when(own_id & mac, F.lit("signed")).otherwise(F.lit("unsigned")),
    )
    signed = judged.where(F.col("verdict") == "signed")
    clashing = ambiguous_entries(signed).withColumn("clash", F.lit(True))
    joined = judged.join(clashing, "entry", "left")
    verdict = (
        F.when(F.col("verdict") != "signed", F.col("verdict"))
        .when(F.col("clash"), F.lit("ambiguous"))
        .otherwise(F.lit("trusted"))
    )
    micros = F.regexp_replace("collect_from", r"(\.\d{6})\d+", "$1")
    return joined.select(
        "entry", "id", "label", "root", "aliases", "case_insensitive",
        F.when(F.col("verdict") != "malformed", F.try_to_timestamp(micros)).alias("collect_from"),
        verdict.alias("verdict"),
    )


def consented(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("verdict") == "trusted").drop("verdict")


def refused_count(judged: DataFrame) -> DataFrame:
    return judged.agg(F.count_if(F.col("verdict") != "trusted").alias("refused_projects"))
