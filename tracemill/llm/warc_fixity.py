"""Merkle fixity audit of web archives.

Every record is hashed; the records whose offsets fall into one range of an archive form a node, and ranges of a
level join into ranges ``FANOUT`` times as wide up to the archive's root. A node's digest covers its children in
offset order. Ranges are fixed spans of bytes, not record numbers, so a lost record disturbs its own range only,
and a node never has more than ``FANOUT`` children (or the records that begin in ``SPAN`` bytes).

Two replicas are compared at their roots, and only the children of mismatching nodes are looked at next: from the
roots down every step joins the few bad branches with one level of each tree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import stage

SPAN = 65_536
FANOUT = 16
#: Pages of one archive: ids by the thousand.
ARCHIVE_PAGES = 1000


def warc_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 archive_pages: int = ARCHIVE_PAGES) -> DataFrame:
    """WARC/1.0 resource records of pages: ``archive, page_id, length, record`` (bytes).

    Archives hold the pages of consecutive ids, in the order of id. A null url or html counts as empty; a null id
    goes to an archive of its own with null number.
    """
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.coalesce(F.col(f"`{url_col}`"), F.lit("")).alias("url"),
                        F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"))
    body = F.encode("html", "UTF-8")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"))
    made = rows.select(
        F.floor(F.col("page_id") / archive_pages).alias("archive"), "page_id",
        F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8")).alias("record"))
    return made.withColumn("length", F.octet_length("record").cast("long"))


def placed(rows: DataFrame) -> DataFrame:
    """Rows with ``archive``, ``page_id`` and ``length``, and the ``offset`` each has in its archive.

    Hash records before placing them: the window sorts whatever columns the rows have, an archive at a time.
    """
    before = Window.partitionBy("archive").orderBy("page_id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def digest(record: Column) -> Column:
    """Digest of a record; a null record hashes like an empty one."""
    return F.sha2(F.coalesce(record, F.lit("").cast("binary")), 256)


def leaves(records: DataFrame) -> DataFrame:
    """One digest per record: ``archive, offset, length, digest``; rows that bring their digest keep it."""
    own = F.col("digest") if "digest" in records.columns else digest(F.col("record"))
    return records.select("archive", "offset", "length", own.alias("digest"))


def _node(children: DataFrame, at: str, *parts: str) -> DataFrame:
    """Parents of rows with ``archive``, ``place``: a digest over ``parts`` of the children in the order of ``at``."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.concat_ws(":", *[F.col(p).cast("string") for p in parts]).alias("own"))))
    return children.groupBy("archive", "place").agg(F.sha2(F.concat_ws("|", F.transform(ordered, lambda c: c["own"])), 256).alias("digest"))


def tree(leaf: DataFrame, levels: int, span: int = SPAN, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels of the tree from the finest ranges to the roots: ``archive, place, digest``, each a staged table."""
    level = _node(leaf.withColumn("place", F.floor(F.col("offset") / span)), "offset", "offset", "length", "digest")
    found = [stage(level, "merkle")]
    for _ in range(levels - 1):
        children = found[-1].withColumn("own", F.col("place")).withColumn("place", F.floor(F.col("place") / fanout))
        found.append(stage(_node(children, "own", "own", "digest"), "merkle"))
    return found


def _differing(left: DataFrame, right: DataFrame, key: list[str], value: list[str]) -> DataFrame:
    """Keys whose values differ between two tables, or that one of them lacks."""
    a = left.select(*key, F.struct(*value).alias("left"))
    b = right.select(*[F.col(k).alias(f"r_{k}") for k in key], F.struct(*value).alias("right"))
    same = [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in key]
    joined = a.join(b, reduce(lambda x, y: x & y, same), "full_outer").where(~F.col("left").eqNullSafe(F.col("right")))
    return joined.select(*[F.coalesce(k, f"r_{k}").alias(k) for k in key], "left", "right")


def _within(level: DataFrame, bad: DataFrame, parent) -> DataFrame:
    bad = bad.select(F.col("archive").alias("b_archive"), F.col("place").alias("b_place"))
    return level.join(bad, F.col("archive").eqNullSafe(F.col("b_archive")) & (parent == F.col("b_place")), "left_semi")


def audit(replica_a: DataFrame, replica_b: DataFrame, span: int = SPAN, fanout: int = FANOUT) -> DataFrame:
    """Where two replicas of archives differ: ``archive, offset, length_a, length_b, status``.

    Inputs are tables of (``archive``, ``offset``, ``length``) and ``record`` or its ``digest``; ``status`` is
    changed, missing (in b) or extra (in b).

    * null records hash like empty ones, null archive numbers are one archive
    * of rows that repeat an (archive, offset) the set of digests is compared
    * equal or empty replicas give an empty result; other columns, whatever their names, are not read
    """
    # A repeated place is one leaf with the digests of its rows in order.
    leaf = [
        stage(leaves(r).groupBy("archive", "offset").agg(
            F.max("length").alias("length"),
            F.sha2(F.concat_ws(",", F.array_sort(F.collect_set("digest"))), 256).alias("digest")), "fixity")
        for r in (replica_a, replica_b)
    ]
    reach = max((r.agg(F.max("offset")).first()[0] or 0) for r in leaf) // span
    levels = 1
    while reach:
        reach //= fanout
        levels += 1
    trees = [tree(one, levels, span, fanout) for one in leaf]
    bad = stage(_differing(trees[0][-1], trees[1][-1], ["archive", "place"], ["digest"]), "bad-roots")
    for depth in range(levels - 2, -1, -1):
        near = [_within(t[depth], bad, F.floor(F.col("place") / fanout)) for t in trees]
        bad = stage(_differing(*near, ["archive", "place"], ["digest"]), "bad-ranges")
    near = [_within(one, bad, F.floor(F.col("offset") / span)) for one in leaf]
    found = _differing(*near, ["archive", "offset"], ["length", "digest"])
    status = F.when(F.col("right").isNull(), "missing").when(F.col("left").isNull(), "extra").otherwise("changed")
    return found.select("archive", "offset", F.col("left.length").alias("length_a"),
                        F.col("right.length").alias("length_b"), status.alias("status"))
