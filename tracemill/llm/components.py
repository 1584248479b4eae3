"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import stage


class Forest:
    """Union-find inside a task: turns the links seen so far into one link per node to its smallest known member."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, node: int) -> int:
        root = node
        while (above := self.parent.get(root, root)) != root:
            root = above
        while node != root:
            self.parent[node], node = root, self.parent.get(node, node)
        return root

    def link(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        low, high = min(a, b), max(a, b)
        self.parent[low], self.parent[high] = low, low
        return True

    def drain(self) -> list[tuple[int, int]]:
        rows = [(node, self.find(node)) for node in list(self.parent)]
        self.parent = {}
        return [(node, root) for node, root in rows if node != root]


def _stars(links: DataFrame) -> DataFrame:
    """One round. A node's smallest neighbour is a combining aggregate, so a centre of many links is no hot group."""
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = stage(large.where("a <> b").distinct(), "large-star")
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(``node``, ``root``) of all nodes that are not the smallest of their component; links are (``a``, ``b``), any order.

    Every round's links are a table in the shared scratch folder. The rounds end when a round changes nothing; their
    number grows with the logarithm of the longest chain.
    """
    ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    current = stage(ordered.distinct(), "links")
    summary = [F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
    before = current.agg(*summary).first()
    while before[0]:
        current = stage(_stars(current), "stars")
        after = current.agg(*summary).first()
        if after == before:
            break
        before = after
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
