"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words. A document first gets the whole copies its source is certain of
(the integer part of target / size); the rest of the target is drawn as one more copy of some documents. Their
inclusion probabilities are proportional to size (capped at one: such documents are certain too) with expected
words equal to that rest. A document ranks by the odds of its own uniform number over its inclusion odds, and the
lowest ranks are taken until the words are reached: a sample of fixed size, counted in words.

The cut in the order of a source is found on sums over a fixed grid of ranks, twice refined, so that only the
rows of one grid cell out of sixteen million are ever ordered together: a source with a third of all documents
is sums over many tasks. Up to five documents per source, each of the size that fits best into what is still missing,
close the gap that whole documents leave.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import merged, n_words, stage

#: Weights of the sources by code point of their name, repeating; targets stop at CAP times the size.
WEIGHTS = (1, 2, 3)
CAP = 3
GRID = 4096
#: Documents per source that may be added to close its gap.
FILLERS = 5


def _key(source: Column) -> Column:
    """Groups and joins as the source does, with null as a value of its own; sorts null last."""
    return F.struct(source.isNull().alias("absent"), F.coalesce(source, F.lit("")).alias("name"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Target words per source (``key``, ``source_size``, ``target``) from rows of (``key``, ``size``).

    Sources share all words by weight; whatever exceeds ``cap`` times a source is shared again by weight, which
    ends where every source gets the same multiple of its weight or its cap. The window runs over one row per
    source.
    """
    per_source = sizes.groupBy("key").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy("key")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number % len(weights) + 1).cast("int"))
    rows = stage(per_source.withColumn("weight", weight).withColumn("limit", F.col("source_size") * float(cap)), "sources")
    # Capped first are those with the least room per weight.
    order = Window.orderBy(F.col("limit") / F.col("weight"), "key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = rows.withColumn("level", level)
    fits = F.col("level") * F.col("weight") <= F.col("limit")
    final = F.min(F.when(fits, F.struct(F.col("limit") / F.col("weight"), F.col("key"), F.col("level")))).over(everything)
    return levels.select(
        "key", "source_size",
        F.least(F.col("limit"), F.coalesce(final["level"], F.lit(float("inf"))) * F.col("weight")).alias("target"),
    )


def _inclusion_rate(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source the factor that turns a size into an inclusion probability with the wanted expected words.

    Solved on the counts of distinct sizes: the longest documents reach probability one, and the words that
    remain fall on the others in proportion to size.
    """
    sizes = rows.where("size > 0").groupBy("key", "size").agg(F.count("*").cast("double").alias("n"))
    down = Window.partitionBy("key").orderBy(F.desc("size"))
    above = down.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("key")
    words, squares = F.col("n") * F.col("size"), F.col("n") * F.col("size") * F.col("size")
    solved = sizes.join(sources.select("key", "rest"), "key").withColumn(
        "rate",
        (F.col("rest") - F.coalesce(F.sum(words).over(above), F.lit(0.0)))
        / (F.sum(squares).over(whole) - F.coalesce(F.sum(squares).over(above), F.lit(0.0))),
    )
    fits = F.col("rate") * F.col("size") <= 1
    return solved.groupBy("key").agg(
        F.greatest(F.max(F.when(fits, F.col("rate"))), F.lit(0.0)).alias("rate"))


def _crossing(cells: DataFrame, cell: str) -> DataFrame:
    """Per source the grid cell in which the running words reach the rest, and the words before it."""
    running = Window.partitionBy("key").orderBy(cell).rowsBetween(Window.unboundedPreceding, 0)
    summed = cells.withColumn("upto", F.sum("words").over(running))
    return summed.where("upto >= need").groupBy("key").agg(
        F.min(cell).alias("cut"), F.min(F.col("upto") - F.col("words")).alias("before"))


def _fillers(marked: DataFrame) -> DataFrame:
    """(``key``, ``doc_id``, ``size``) of the few documents that close the gap of a source, one per round and source.

    Whole documents leave a gap of up to one document at the cut. Each round takes the largest document that fits
    into it; the last one the document whose size is nearest, if that brings the source nearer to its target. Rows
    without id share a verdict, so all of them would come in at once: they close no gap.
    """
    candidates = marked.where("size > 0 and not chosen and reached is not null and doc_id is not null")
    found = stage(candidates.select("key", "doc_id", "size").limit(0), "fillers")
    for number in range(FILLERS):
        filled = found.groupBy("key").agg(F.sum("size").alias("filled"))
        left = candidates.join(found.select("key", "doc_id"), ["key", "doc_id"], "left_anti").join(filled, "key", "left")
        missing = F.col("rest") - F.col("reached") - F.coalesce("filled", F.lit(0))
        left = left.withColumn("off", F.abs(missing - F.col("size")))
        last = number == FILLERS - 1
        left = left.where(F.col("off") < F.abs(missing) if last else F.col("size") <= missing)
        nearest = left.groupBy("key").agg(F.min("off").alias("off"))
        # Sizes on both sides of the gap may be equally near: the smaller id decides.
        first = left.join(nearest, ["key", "off"]).groupBy("key").agg(F.min("doc_id").alias("doc_id"))
        picked = stage(left.join(first, ["key", "doc_id"]).groupBy("key", "doc_id").agg(F.sum("size").alias("size")), "filler")
        found = stage(found.unionByName(picked), "fillers")
    return found


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = "mix") -> DataFrame:
    """Copies of each document in the mix: ``doc_id, size, source_size, target, copies, taken, source``.

    One row per input row. ``size`` counts words (null text: none), ``taken`` is ``copies * size``. The same input
    gives the same mix: ranks come from a keyed hash of the id.

    * a null source is a source of its own, last in order; documents without words take 0 copies beyond the
      certain ones, and a source without words has target 0
    * rows repeating an id share its rank and so its verdict; ties in rank go to the smaller id
    * an empty table gives an empty result; other columns, whatever their names, are not read
    """
    source = F.col(f"`{source_col}`").cast("string")
    rows = stage(docs.select(F.col(f"`{id_col}`").alias("doc_id"), _key(source).alias("key"),
                             n_words(F.col(f"`{text_col}`")).alias("size")), "sizes")

    certain = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    sources = targets(rows, weights, cap).withColumn("certain", certain.cast("long"))
    sources = stage(sources.withColumn(
        "rest", F.greatest(F.col("target") - F.col("certain") * F.col("source_size"), F.lit(0.0))), "targets")
    rates = stage(_inclusion_rate(rows, sources), "rates")
    params = sources.join(rates, "key", "left").fillna(0.0, ["rate"])

    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")), 11) + 0.5) / float(2**53)
    chance = F.least(F.col("rate") * F.col("size"), F.lit(1.0))
    odds = uniform / (1 - uniform) * (1 - chance) / chance
    # In [0, 1): certain documents in the lower half, the others by their Pareto rank in the upper half.
    rank = F.when(chance <= 0, F.lit(None)).when(chance >= 1, uniform / 2).otherwise(0.5 + odds / (1 + odds) / 2)
    ranked = stage(rows.join(params, "key").withColumn("rank", rank.cast("double")), "ranked")

    drawn = ranked.where("rank is not null and rest > 0")
    first = F.least(F.floor(F.col("rank") * GRID), F.lit(GRID - 1))
    second = F.floor((F.col("rank") * GRID - first) * GRID)
    cells = drawn.groupBy("key", first.alias("cell")).agg(F.sum("size").alias("words"), F.max("rest").alias("need"))
    outer = stage(_crossing(cells, "cell").select("key", F.col("cut").alias("outer"), F.col("before").alias("outer_words")), "outer")
    inside = drawn.join(outer, "key").where(first == F.col("outer"))
    cells = inside.groupBy("key", second.alias("cell")).agg(
        F.sum("size").alias("words"), F.max(F.col("rest") - F.col("outer_words")).alias("need"))
    inner = stage(_crossing(cells, "cell").select("key", F.col("cut").alias("inner"), F.col("before").alias("inner_words")), "inner")
    # The few documents of one cell, in order; the cut lies before the one that would pass the rest by more.
    in_order = Window.partitionBy("key").orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    ordered = inside.join(inner, "key").where(second == F.col("inner")).withColumn(
        "upto", F.col("outer_words") + F.col("inner_words") + F.sum("size").over(in_order))
    stays = F.col("upto") <= F.col("rest")
    at_cut = ordered.groupBy("key").agg(
        F.max(F.when(stays, F.struct("rank", "doc_id"))).alias("last"),
        F.min("rank").alias("cell_starts"),
        F.max(F.when(stays, F.col("upto"))).alias("reached"),
        F.max(F.col("outer_words") + F.col("inner_words")).alias("reached_before"),
    )
    cut = stage(at_cut.select(
        "key", "last", "cell_starts", F.coalesce("reached", "reached_before").alias("reached")), "cut")
    params = params.join(cut, "key", "left")
    # Without a crossing (rounding), every document with a rank is taken.
    chosen = F.col("rank").isNotNull() & (F.col("rest") > 0) & F.when(
        F.col("reached").isNull(), True).otherwise(F.coalesce(
            (F.col("rank") < F.col("last.rank"))
            | ((F.col("rank") == F.col("last.rank")) & (F.col("doc_id") <= F.col("last.doc_id"))),
            F.col("rank") < F.col("cell_starts")))
    kept = ["doc_id", "key", "size", "rank"]
    marked = ranked.select(*kept).join(params, "key").withColumn("chosen", F.coalesce(chosen, F.lit(False)))

    marked = stage(marked, "chosen")
    fillers = _fillers(marked)
    final = marked.join(fillers.select("key", F.col("doc_id").alias("filler"), F.lit(True).alias("fills")),
                        marked["key"].eqNullSafe(fillers["key"]) & (F.col("doc_id") == F.col("filler")), "left").drop(fillers["key"])
    extra = (F.col("chosen") | F.coalesce("fills", F.lit(False))).cast("long")
    copies = F.col("certain") + extra
    return final.select(
        "doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"),
        F.when(~F.col("key.absent"), F.col("key.name")).alias("source"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = "mix") -> DataFrame:
    """The mix itself: every document as often as it is taken, with all its columns; null ids are ids like others."""
    plan = mix(docs, id_col, text_col, source_col, weights, cap, seed).where("copies > 0")
    # Rows that repeat an id may differ in source or size: all three say which row a number of copies belongs to.
    plan = stage(plan.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"),
                             F.col("copies").alias("__copies")).distinct(), "mix")
    same = (
        F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & F.col(f"`{source_col}`").cast("string").eqNullSafe(F.col("__source"))
        & (n_words(F.col(f"`{text_col}`")) == F.col("__size")))
    repeated = docs.join(merged(plan), same).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    return repeated.drop("__id", "__source", "__size", "__copies", "__copy")
