"""Toxicity as an ordered severity grade, by cumulative-link regression on sparse text features.

Features are the distinct lower-cased words of a whole text and the first four to six letters of longer ones, which
stand for all endings of a stem. The model is P(grade > k) = sigmoid(w x - t_k): one weight per feature shared by
all grades, and ordered thresholds. It is fitted on a bounded sample of labelled documents; features are chosen on
counts over that sample, made by Spark; scoring reads every document in one pass with a vocabulary of fixed size.

The labels say toxic or not. Grades above zero split the toxic documents of the sample into equal parts by how many
distinct marker words they hold, markers being words that are many times as frequent in toxic documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import stage

LETTERS = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6)
#: Bounds of the fit: labelled documents, features, grades.
FIT_ROWS, MAX_FEATURES, GRADES = 16_000, 1024, 4
MIN_DOCUMENTS = 4
#: A marker is this many times as frequent in toxic documents.
MARKER_RATIO = 20.0


def features(text: str | None) -> set[str]:
    """Distinct words and stems of a whole text; none for null."""
    words = set(LETTERS.findall(text.lower())) if text else set()
    return words | {word[:n] + "*" for word in words for n in STEMS if len(word) > n}


@dataclass
class Model:
    """Weights by feature and ascending thresholds; grade k+1 or more has odds exp(w x - thresholds[k])."""

    vocabulary: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def margin(self, text: str | None) -> float:
        """Sum of the weights of a text's features: looks words and stems up without building their set."""
        if not text:
            return 0.0
        known, hit = self.vocabulary, set()
        for word in set(LETTERS.findall(text.lower())):
            if word in known:
                hit.add(known[word])
            for n in STEMS:
                if len(word) > n and (at := known.get(word[:n] + "*")) is not None:
                    hit.add(at)
        return float(self.weights[list(hit)].sum()) if hit else 0.0

    def above(self, margins: np.ndarray) -> np.ndarray:
        """P(grade > k) per row and k."""
        return 1 / (1 + np.exp(-np.clip(margins[:, None] - self.thresholds, -40, 40)))


def fit_ordinal(rows: list[list[int]], grades: np.ndarray, n_features: int, l2: float = 0.5,
                steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood cumulative logit with an L2 penalty on the weights; deterministic full-batch Adam.

    Thresholds are the first and positive increments, so they stay ordered.
    """
    n, levels = len(rows), int(grades.max()) if len(grades) else 0
    if not levels:
        return np.zeros(n_features), np.full(1, 20.0)
    at = np.concatenate([np.full(len(r), i) for i, r in enumerate(rows)] + [np.zeros(0)]).astype(np.int64)
    feature = np.concatenate([np.asarray(r, dtype=np.int64) for r in rows] + [np.zeros(0, dtype=np.int64)])
    share = np.array([np.mean(grades > k) for k in range(levels)]).clip(1e-4, 1 - 1e-4)
    first = np.log((1 - share) / share)
    steps_up = np.maximum(np.diff(first), 0.05)
    theta = np.concatenate([np.zeros(n_features), first[:1], np.log(steps_up)])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    row = np.arange(n)
    for step in range(1, steps + 1):
        w, rises = theta[:n_features], np.exp(theta[n_features + 1:])
        cuts = theta[n_features] + np.r_[0.0, np.cumsum(rises)]
        margin = np.bincount(at, weights=w[feature], minlength=n)
        cdf = 1 / (1 + np.exp(-np.clip(np.r_[-np.inf, cuts, np.inf] - margin[:, None], -40, 40)))
        low, high = cdf[row, grades], cdf[row, grades + 1]
        low, high = np.where(grades == 0, 0.0, low), np.where(grades == levels, 1.0, high)
        p = np.maximum(high - low, 1e-9)
        d_low, d_high = -low * (1 - low) / p, high * (1 - high) / p
        d_cut = np.zeros(levels)
        np.add.at(d_cut, grades[grades < levels], -d_high[grades < levels])
        np.add.at(d_cut, grades[grades > 0] - 1, -d_low[grades > 0])
        d_margin = d_high + d_low
        gradient = np.empty_like(theta)
        gradient[:n_features] = np.bincount(feature, weights=d_margin[at], minlength=n_features) + l2 * w
        gradient[n_features] = d_cut.sum()
        gradient[n_features + 1:] = [d_cut[k + 1:].sum() * rise for k, rise in enumerate(rises)]
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:n_features], theta[n_features] + np.r_[0.0, np.cumsum(np.exp(theta[n_features + 1:]))]


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic") -> Model:
    """Fit on at most ``fit_rows`` labelled documents, chosen by a hash of their id.

    Only ids, at most ``max features`` counts and sparse vectors of the sample come to the driver. Null labels and
    ids do not take part; of several labels of a document the highest counts, of several rows of an id the text with the
    smallest hash. Without toxic labels the model finds nothing toxic.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{label_col}`").cast("int").alias("label")).dropna()
    known = known.groupBy("__id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64(F.col("__id").cast("string")), "__id").limit(fit_rows)
    # At most fit_rows rows of two numbers: safe to broadcast.
    sample = docs.join(F.broadcast(stage(chosen, "labels")), F.col(f"`{id_col}`") == F.col("__id"))
    sample = sample.select("__id", (F.col("label") > 0).cast("int").alias("label"), F.col(f"`{text_col}`").alias("text"))
    # One row of an id, however often it repeats; combines before its shuffle.
    sample = stage(sample.groupBy("__id").agg(F.max("label").alias("label"), F.min_by("text", F.xxhash64("text")).alias("text")), "fit")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            all_of, toxic = Counter(), Counter()
            for label, text in zip(batch["label"], batch["text"], strict=True):
                found = features(text)
                all_of.update(found)
                if label:
                    toxic.update(found)
            yield pd.DataFrame([(f, n, toxic[f]) for f, n in all_of.items()], columns=["feature", "n", "t"])

    totals = sample.agg(F.count("*"), F.sum("label")).first()
    rows, toxic = totals[0], totals[1] or 0
    if not toxic or toxic == rows:
        return Model({}, np.zeros(0), np.full(1, 20.0 if not toxic else -20.0))
    base = toxic / rows
    counts = sample.mapInPandas(count, "feature string, n bigint, t bigint").groupBy("feature").agg(
        F.sum("n").alias("n"), F.sum("t").alias("t")).where(F.col("n") >= MIN_DOCUMENTS)
    surprise = (F.col("t") - F.col("n") * base) / F.sqrt(F.col("n") * base * (1 - base))
    best = counts.withColumn("z", surprise).where("abs(z) >= 3").orderBy(F.desc(F.abs("z")), "feature").limit(MAX_FEATURES).collect()
    vocabulary = {row.feature: i for i, row in enumerate(best)}
    markers = {i for i, row in enumerate(best) if not row.feature.endswith("*")
               and row.t / toxic >= MARKER_RATIO * (row.n - row.t + 0.5) / (rows - toxic)}

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [sorted(vocabulary[f] for f in features(text) if f in vocabulary) for text in batch["text"]]
            yield pd.DataFrame({"label": batch["label"], "hits": found})

    vectors = sample.mapInPandas(encode, "label int, hits array<int>").collect()
    hits = [list(row.hits) for row in vectors]
    label = np.array([row.label for row in vectors])
    strength = np.array([len(markers.intersection(h)) for h in hits], dtype=float)
    # Equal parts of the toxic documents; parts that coincide (few distinct strengths) merge.
    edges = np.unique(np.quantile(strength[label > 0], [k / (GRADES - 1) for k in range(1, GRADES - 1)]))
    grades = np.where(label > 0, 1 + np.searchsorted(edges, strength, side="left"), 0)
    order = {value: i for i, value in enumerate(sorted({0, *grades.tolist()}))}
    grades = np.array([order[value] for value in grades.tolist()])
    weights, thresholds = fit_ordinal(hits, grades, len(vocabulary))
    return Model(vocabulary, weights, thresholds)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``doc_id``, ``expected_severity``, ``p_toxic``, ``toxic``) of every row: the expected grade, the chance of
    any grade above zero, and whether that is at least one half.

    * null and empty texts have no features and get the base rate; long texts are read whole
    * repeated rows get equal scores; an empty table gives an empty result; other columns are not read
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            above = model.above(np.array([model.margin(text) for text in batch["text"]], dtype=float))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "expected_severity": above.sum(axis=1), "p_toxic": above[:, 0]})

    scored = rows.mapInPandas(run, f"doc_id {dict(rows.dtypes)['doc_id']}, expected_severity double, p_toxic double")
    return scored.withColumn("toxic", F.col("p_toxic") >= 0.5)


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents that are not toxic, with all their columns, in one pass."""

    @F.pandas_udf("boolean")
    def clean(text: pd.Series) -> pd.Series:
        return pd.Series(model.above(np.array([model.margin(t) for t in text], dtype=float))[:, 0] < 0.5)

    return docs.where(clean(F.col(f"`{text_col}`")))
