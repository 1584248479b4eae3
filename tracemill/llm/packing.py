"""Packing documents into sequences of a fixed number of tokens, by exact-complement hashing.

Documents become pieces of at most ``capacity`` tokens. Which lengths go together is decided on the counts per
length alone, a table of at most ``capacity`` rows however large the corpus: lengths that exactly fill the gap of
a sequence are looked up as single, pair and triple sums, and whole multiples of a combination are consumed
at once; what has no exact complement is filled by best fit. The decision is a list of slot ranges per length,
again bounded by the capacity. Pieces then only need their rank among pieces of their length, counted in
bounded chunks of the staged table, to find their sequence and offset.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import stage

CAPACITY = 1024
END_ID = 2
#: Rows of the staged table that are ranked together.
CHUNK_ROWS = 65_536


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoder(path: str):
    """A byte-level BPE vocabulary file as a fast encoder of text without added tokens.

    The file's vocabulary numbers merges in their order, so ids serve as ranks. A test holds the ids against
    those of the tokenizers library.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = {token["id"] for token in spec.get("added_tokens", [])}
    # Byte-level vocabularies write bytes that do not print as characters from 256 on.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    to_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if i not in special}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def token_ids(path: str) -> Callable[[str], list[int]]:
    """Ids of a text as the tokenizers library gives them: added tokens of the file are found first, the longest first."""
    with open(path, encoding="utf-8") as file:
        added = json.load(file).get("added_tokens", [])
    if any(token.get(flag) for token in added for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that take in what stands around them are not supported")
    ordinary, ids = encoder(path).encode_ordinary, {token["content"]: token["id"] for token in added}
    found = re.compile("|".join(re.escape(content) for content in sorted(ids, key=len, reverse=True)))

    def encode(text: str) -> list[int]:
        if not ids or not found.search(text):
            return ordinary(text)
        out, at = [], 0
        for match in found.finditer(text):
            out += [*ordinary(text[at:match.start()]), ids[match[0]]]
            at = match.end()
        return [*out, *ordinary(text[at:])]

    return encode


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
           end_id: int = END_ID, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Token pieces of every document: ``doc_id, piece, start, length, ids_crc32`` and, if asked, ``ids``.

    A document is the ids of its whole text (null: none) and the end id. One of more than ``capacity`` tokens is
    cut so that only its first piece is shorter.
    """
    vocabulary = path or vocabulary_path()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, piece int, start bigint, length bigint, ids_crc32 bigint"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = token_ids(vocabulary)
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.array([*(encode(text) if text else ()), end_id], dtype="<u4")
                starts = [0, *range((len(ids) - 1) % capacity + 1, len(ids), capacity)]
                for number, (start, end) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    own = ids[start:end]
                    row = (doc, number, start, end - start, zlib.crc32(own.tobytes()))
                    out.append((*row, own.tolist()) if with_ids else row)
            names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(cut, schema + (", ids array<bigint>" if with_ids else ""))


class Complements:
    """Single, pair and triple sums of the available lengths, looked up by the gap they fill.

    ``held`` are the lengths of the sequence being composed. Counts only fall, so a combination that is used up
    never returns: each sum remembers how far its list of combinations is, and all lookups together walk every
    list once.
    """

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.held: list[int] = []
        self.pair_at: dict[int, int] = {}
        self.triple_at: dict[int, int] = {}

    def _left(self, *lengths: int) -> bool:
        return all(self.counts[x] >= lengths.count(x) for x in lengths)

    def _free(self, *lengths: int) -> bool:
        return all(self.counts[x] >= lengths.count(x) + self.held.count(x) for x in lengths)

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self._free(gap) else None

    def _pairs(self, total: int) -> Iterator[tuple[int, int]]:
        """Pairs with this sum that are not used up, larger member first."""
        larger = self.pair_at.get(total, total - 1)
        while larger * 2 >= total > larger > 0 and not self._left(larger, total - larger):
            larger -= 1
        self.pair_at[total] = larger
        while larger * 2 >= total > larger > 0:
            if self._left(larger, total - larger):
                yield larger, total - larger
            larger -= 1

    def pair(self, gap: int) -> tuple[int, ...] | None:
        return next((found for found in self._pairs(gap) if self._free(*found)), None)

    def _hopeless(self, largest: int, gap: int) -> bool:
        return not self.counts[largest] or next(self._pairs(gap - largest), None) is None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        largest = self.triple_at.get(gap, gap - 2)
        while largest * 3 >= gap and largest > 0 and self._hopeless(largest, gap):
            largest -= 1
        self.triple_at[gap] = largest
        while largest * 3 >= gap and largest > 0:
            if self.counts[largest]:
                found = next((rest for rest in self._pairs(gap - largest) if self._free(largest, *rest)), None)
                if found:
                    return (largest, *found)
            largest -= 1
        return None

    def fill(self, gap: int) -> tuple[int, ...] | None:
        return self.single(gap) or self.pair(gap) or self.triple(gap)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Which lengths share a sequence, and how many sequences of the kind there are.

    Longest lengths open sequences. A gap is filled by an exact combination if one is left, else by the longest
    length that fits, after which the exact lookup is tried on the smaller gap. Each combination is used as often
    as the counts allow, so at least one length runs out (or cannot be used again) per step.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, number in histogram.items():
        counts[length] = number
    index = Complements(counts)
    patterns = []
    for opener in range(capacity, 0, -1):
        while counts[opener]:
            members, gap = [opener], capacity - opener
            index.held = members
            while gap:
                exact = index.fill(gap)
                if exact is None:
                    left = counts[1:gap + 1].copy()
                    for length in members:
                        if length <= gap:
                            left[length - 1] -= 1
                    fitting = np.flatnonzero(left > 0)
                    if not len(fitting):
                        break
                    exact = (int(fitting[-1]) + 1,)
                members += exact
                gap -= sum(exact)
            used = {length: members.count(length) for length in set(members)}
            times = int(min(counts[length] // number for length, number in used.items()))
            for length, number in used.items():
                counts[length] -= number * times
            patterns.append((tuple(members), times))
    return patterns


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """Per length the ranges of ranks: rows of (first rank, first sequence, offset in each of its sequences)."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for members, times in patterns:
        offset = 0
        for length in members:
            found.setdefault(length, []).append((ranks.get(length, 0), sequence, offset))
            ranks[length] = ranks.get(length, 0) + times
            offset += length
        sequence += times
    return {length: np.array(rows, dtype=np.int64) for length, rows in found.items()}


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give every row of a table with ``length`` (1 to ``capacity``) its ``sequence_id`` and ``offset``."""
    staged = stage(cut, "pieces")
    columns = staged.columns
    # Files by two hashes of their path: rows of files that share the first one are ranked together, by the second.
    path = F.col("_metadata.file_path")
    located = staged.select(
        *columns, F.xxhash64(path).alias("__file"), F.xxhash64(path, F.lit(1)).alias("__tie"),
        F.col("_metadata.row_index").alias("__row"))
    located = located.withColumn("__chunk", F.floor(F.col("__row") / CHUNK_ROWS))

    per_chunk = stage(located.groupBy("length", "__file", "__chunk").agg(F.count("*").alias("rows")), "lengths")
    # At most `capacity` rows reach the driver.
    histogram = {row.length: row.rows for row in per_chunk.groupBy("length").agg(F.sum("rows").alias("rows")).collect()}
    ranges = slots(plan(histogram, capacity))

    before = Window.partitionBy("length").orderBy("__file", "__chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_chunk.withColumn("__start", F.coalesce(F.sum("rows").over(before), F.lit(0))).drop("rows")
    within = Window.partitionBy("length", "__file", "__chunk").orderBy("__row", "__tie")
    ranked = located.withColumn("__rank", F.row_number().over(within) - 1).join(starts, ["length", "__file", "__chunk"])
    ranked = ranked.select(*columns, (F.col("__start") + F.col("__rank")).alias("__rank"))

    @F.pandas_udf("struct<sequence_id bigint, offset bigint>")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        lengths, order = length.to_numpy(), rank.to_numpy()
        out = np.zeros((len(lengths), 2), dtype=np.int64)
        for value in np.unique(lengths):
            rows, here = ranges[int(value)], lengths == value
            at = np.searchsorted(rows[:, 0], order[here], side="right") - 1
            out[here, 0] = rows[at, 1] + order[here] - rows[at, 0]
            out[here, 1] = rows[at, 2]
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    return ranked.withColumn("__slot", slot("length", "__rank")).select(*columns, "__slot.sequence_id", "__slot.offset")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Pieces of all documents with their place: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    * a null or empty text is one piece with only the end id; a long text is cut into several pieces
    * pieces of equal length are interchangeable; repeated rows are packed as often as they occur
    * an empty table gives an empty result; other columns, whatever their names, are not read
    """
    return place(pieces(docs, id_col, text_col, capacity, end_id, path), capacity)
