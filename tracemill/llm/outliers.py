"""Quality rules with robust multivariate outliers per language and source.

Every document becomes a vector of transformed text statistics. Per group the minimum-covariance-determinant
estimate is found by concentration steps: distances under the current estimate, then mean and covariance of the
half with the smallest distances, again and again. A step is one aggregation over the narrow statistics table into
a fixed number of distance bins per group, each with its count and moments; the half is cut at a bin, and the new
estimate is computed from at most ``BINS`` rows per group. Nothing else of a group is ever brought together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import WORD, stage

SYMBOLS = re.compile(r"[#*$%&|<>]")
MIN_WORDS = 50
#: Names of the transformed statistics, the coordinates of a document.
DIMENSIONS = ("word_length", "symbols", "dup_lines", "repeats")
#: Deviations below these sizes (in transformed units) say nothing: many groups have no symbol or repeated line at all.
#: Those of the two rates of repeats let each reject for itself below the base rule: from about 19 % on, where a group repeats nothing.
FLOORS = (0.08, 0.1, 0.03, 0.03)
STEPS = 8
BINS = 512
#: The size at which a source's own estimate weighs as much as that of its language, and a language's as much as that of everything.
PRIOR = 50
#: Chi-square quantiles for four degrees of freedom: the median, and the limit of one in a million.
CHI2_MEDIAN, CHI2_LIMIT = 3.3567, 33.3768


def word_statistics(text: str | None) -> tuple[int, int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines) of a whole text; null has no words."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    repeats = 0
    if len(words) > 3:
        # Codes in order of first appearance, then one number per window of three.
        seen: dict[str, int] = {}
        codes = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))
        base = len(seen)
        pair = codes[:-2] * base + codes[1:-1]
        if base > 1_000_000:  # keeps the three-word number within 64 bits
            pair = np.unique(pair, return_inverse=True)[1]
        _, inverse, counts = np.unique(pair * base + codes[2:], return_inverse=True, return_counts=True)
        again = counts[inverse] > 1
        covered = np.zeros(len(words), dtype=bool)
        for shift in range(3):
            covered[shift:len(words) - 2 + shift] |= again
        repeats = int(covered.sum())
    return (len(words), sum(map(len, words)), len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeats, len(lines))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
               source_col: str = "source") -> DataFrame:
    """Counts of every whole text, with the group columns ``lang`` and ``source``."""
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{lang_col}`").cast("string").alias("lang"),
        F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{text_col}`").alias("text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = pd.DataFrame([word_statistics(text) for text in batch["text"]], columns=names, dtype="int64")
            yield pd.concat([batch[["doc_id", "lang", "source"]].reset_index(drop=True), counts], axis=1)

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInPandas(count, f"doc_id {kind}, lang string, source string, " + ", ".join(f"{n} bigint" for n in names))


def vector() -> list[Column]:
    """The transformed statistics: log mean word length, root of symbols per word, log(1 + rate) of what repeats."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log(F.greatest(F.col("word_chars") / words, F.lit(0.5))),
        F.sqrt(F.col("n_symbols") / words),
        F.log1p(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        F.log1p(F.col("n_repeat_words") / words),
    ]


def _squared_distance(columns: list[str], centre: str, inverse: str) -> Column:
    """Squared Mahalanobis distance to the estimate in array columns, the inverse stored row by row."""
    n = len(columns)
    off = [F.col(c) - F.col(centre)[i] for i, c in enumerate(columns)]
    terms = [off[i] * off[j] * F.col(inverse)[i * n + j] for i in range(n) for j in range(n)]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return F.greatest(total, F.lit(0.0))


PAIRS = list(combinations_with_replacement(range(len(DIMENSIONS)), 2))
MOMENTS = [f"s{i}" for i in range(len(DIMENSIONS))] + [f"q{i}{j}" for i, j in PAIRS]


def _estimate(n: float, moments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = len(DIMENSIONS)
    mean = moments[:d] / n
    covariance = np.zeros((d, d))
    for (i, j), value in zip(PAIRS, moments[d:], strict=True):
        covariance[i, j] = covariance[j, i] = value / n - mean[i] * mean[j]
    return mean, covariance


ESTIMATE = "grp string, size bigint, centre array<double>, inverse array<double>"


def _concentrate(rows: pd.DataFrame) -> pd.DataFrame:
    """From the bins of one group to its next estimate: of the bins that hold the half nearest to the current one."""
    rows = rows.sort_values("bin")
    counts = rows["n"].to_numpy(dtype=float)
    half = (counts.sum() + len(DIMENSIONS) + 1) // 2
    inner = rows.iloc[:int(np.searchsorted(np.cumsum(counts), half)) + 1]
    mean, covariance = _estimate(inner["n"].sum(), inner[MOMENTS].sum().to_numpy(dtype=float))
    inverse = np.linalg.inv(covariance + np.diag(np.square(FLOORS)))
    return pd.DataFrame([(rows["grp"].iloc[0], int(counts.sum()), mean.tolist(), inverse.ravel().tolist())],
                        columns=["grp", "size", "centre", "inverse"])


def _binned(rows: DataFrame, bins: Column) -> DataFrame:
    x = [F.col(f"x{i}") for i in range(len(DIMENSIONS))]
    return rows.groupBy("grp", bins.alias("bin")).agg(
        F.count("*").alias("n"),
        *[F.sum(x[i]).alias(f"s{i}") for i in range(len(DIMENSIONS))],
        *[F.sum(x[i] * x[j]).alias(f"q{i}{j}") for i, j in PAIRS],
    )


def _distance_bin() -> Column:
    """Logarithmic bins of the squared distance: fine around one, open at both ends."""
    distance = _squared_distance([f"x{i}" for i in range(len(DIMENSIONS))], "centre", "inverse")
    return F.least(F.greatest(F.floor((F.log(distance + 1e-6) + 10.0) * (BINS / 25.0)), F.lit(0)), F.lit(BINS - 1))


def mcd(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """Estimates (``grp, size, centre, inverse, scale``) of rows with ``grp`` and coordinates ``x0..``.

    The first estimate takes the documents nearest to the coordinate-wise medians. A step takes whole bins, so the half
    is larger by up to a bin and the determinant may rise by as much. ``scale`` is the median squared distance over that of a chi-square variable, which makes the
    distances of the clean half comparable.
    """
    x = [f"x{i}" for i in range(len(DIMENSIONS))]
    medians = rows.groupBy("grp").agg(*[F.percentile_approx(c, 0.5, 10_000).alias(f"m{i}") for i, c in enumerate(x)])
    start = medians.select("grp", F.array(*[F.col(f"m{i}") for i in range(len(x))]).alias("centre"),
                           F.array(*[F.lit(1.0 / FLOORS[i] ** 2 if i == j else 0.0)
                                     for i in range(len(x)) for j in range(len(x))]).alias("inverse"))
    current = stage(start, "mcd")
    for _ in range(steps):
        binned = _binned(rows.join(current.select("grp", "centre", "inverse"), "grp"), _distance_bin())
        current = stage(binned.groupBy("grp").applyInPandas(_concentrate, ESTIMATE), "mcd")
    distances = rows.join(current.select("grp", "centre", "inverse"), "grp").groupBy("grp", _distance_bin().alias("bin")).count()

    def median_scale(bins: pd.DataFrame) -> pd.DataFrame:
        bins = bins.sort_values("bin")
        at = int(np.searchsorted(np.cumsum(bins["count"]), bins["count"].sum() / 2))
        middle = float(np.exp((bins["bin"].iloc[at] + 1.0) * 25.0 / BINS - 10.0))
        return pd.DataFrame([(bins["grp"].iloc[0], max(middle / CHI2_MEDIAN, 1.0))], columns=["grp", "scale"])

    scales = distances.groupBy("grp").applyInPandas(median_scale, "grp string, scale double")
    return stage(current.join(scales, "grp"), "mcd")


def _mixture(rows: pd.DataFrame, prior: float) -> pd.DataFrame:
    """Estimates of groups (``centre, inverse, scale, size``) drawn towards those of the groups around them (``up_*``).

    Mean and covariance are those of a mixture of both, by the squares of ``size`` and ``prior``: a few documents cannot
    outvote an outlier among them, so their estimate counts for little.
    """
    d, floors = len(DIMENSIONS), np.diag(np.square(FLOORS))
    made = []
    for row in rows.itertuples(index=False):
        weight = row.size**2 / (row.size**2 + prior**2)
        centre, up = np.array(row.centre), np.array(row.up_centre)
        own, above = (np.linalg.inv(np.array(m).reshape(d, d)) - floors for m in (row.inverse, row.up_inverse))
        between = np.outer(centre - up, centre - up)
        covariance = weight * own + (1 - weight) * above + weight * (1 - weight) * between
        made.append((row.grp, row.size, (weight * centre + (1 - weight) * up).tolist(),
                     np.linalg.inv(covariance + floors).ravel().tolist(), weight * row.scale + (1 - weight) * row.up_scale))
    return pd.DataFrame(made, columns=["grp", "size", "centre", "inverse", "scale"])


def _drawn_to(estimates: DataFrame, above: DataFrame, prior: float) -> DataFrame:
    """Estimates of one level (keys as JSON arrays) with those of the level above mixed in."""
    keys = F.from_json("grp", "array<string>")
    around = above.select(F.col("grp").alias("up"), *[F.col(c).alias(f"up_{c}") for c in ("centre", "inverse", "scale")])
    paired = estimates.withColumn("up", F.to_json(F.slice(keys, 1, F.size(keys) - 1))).join(around, "up").drop("up")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _mixture(batch, prior)

    return paired.mapInPandas(run, f"{ESTIMATE}, scale double")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          source_col: str = "source", min_words: int = MIN_WORDS, limit: float = CHI2_LIMIT,
          prior: float = PRIOR) -> DataFrame:
    """Quality verdict of every document, with its counts, ``distance`` and ``base_failed``.

    ``base_failed``: fewer than ``min_words`` words, or over half of them in repeated windows of three.
    Such documents take no part in the estimates. The others are kept unless their squared robust distance,
    scaled, exceeds ``limit``. The estimate is that of language and source, drawn towards that of the language, which is
    drawn towards that of everything: by size, without a step, half and half in a group of ``prior`` documents.

    * null text: no words, fails the base rule; null language or source is a value of its own
    * very long texts are counted whole; repeated rows count as often as they occur; ties do not matter
    * an empty table gives an empty result; other columns, whatever their names, are not read
    """
    counted = statistics(docs, id_col, text_col, lang_col, source_col)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    coordinates = {f"x{i}": c for i, c in enumerate(vector())}
    rows = stage(counted.withColumn("base_failed", failed).withColumns(coordinates), "statistics")
    x = list(coordinates)

    tag = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    levels = {"__own": F.to_json(F.array(tag("lang"), tag("source"))),
              "__lang": F.to_json(F.array(tag("lang"))), "__all": F.lit("[]")}
    clean = rows.where(~F.col("base_failed"))
    # The same document counts once in each of its three groups.
    grouped = clean.select(*x, F.explode(F.array(*levels.values())).alias("grp"))
    estimates = mcd(grouped)
    level = F.size(F.from_json("grp", "array<string>"))
    languages = _drawn_to(estimates.where(level == 1), estimates.where(level == 0), prior)
    own = stage(_drawn_to(estimates.where(level == 2), languages, prior), "estimates")

    used = own.select(F.col("grp").alias("__grp"), F.struct("centre", "inverse", "scale").alias("__used"))
    judged = rows.withColumn("__key", levels["__own"]).join(used, F.col("__key") == F.col("__grp"), "left")
    distance = _squared_distance(x, "__used.centre", "__used.inverse") / F.col("__used.scale")
    judged = judged.withColumn("distance", F.when(~F.col("base_failed"), distance))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(F.col("distance") <= limit, F.lit(True))).alias("kept"), "distance")
