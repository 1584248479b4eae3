"""SimHash near-duplicates by anchor-point covering.

Anchors are the codewords of a covering code: each fingerprint lies within the covering radius of its home anchor.
Two fingerprints at most ``threshold`` bits apart then meet at an anchor: the one at its home, the other within
radius plus threshold of it. The code is a product of perfect codes on separate blocks of bits, so the home is
found by syndromes, and the anchors in reach are those whose blocks together exceed their radii by at most the
threshold (the exact form of the same bound). As a pair may meet at either home, a fingerprint visits only
anchors above its own home.

With two Golay blocks there are 2^24 anchors and about 150 visits per distinct fingerprint, however large the
corpus. More blocks mean more anchors and more visits: ``blocks`` is the parameter for larger corpora.

Visits are sorted by anchor and compared in vectorised runs. Only a spanning forest of the links leaves a task, so
a dense group of near copies emits a row per fingerprint, not per pair. An anchor at home to more than
``HOME_LIMIT`` fingerprints is split: each chunk of its homes meets the whole stream of visitors in a task of its
own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import merged, one_of_equal, squeezed, stage
from tracemill.llm.components import Forest, components

SHINGLE_WORDS = 3
SEED = 42
THRESHOLD = 3
#: Cyclic codes as (length, generator polynomial, covering radius): both are perfect codes.
GOLAY = (23, 0b110001110101, 3)
HAMMING_15 = (15, 0b10011, 1)
BLOCKS = (GOLAY, GOLAY)
HOME_LIMIT = 4096
#: Comparisons made at once in a task, and nodes of a task's forest before it is emitted.
PAIRS_AT_ONCE = 4_000_000
FOREST_NODES = 500_000


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash: a bit is set if it is in over half of the shingles' XXH64 values; no words: zero."""
    # On bytes, lower() changes A-Z only and split() splits at exactly the six white-space characters.
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    stops = (ends - 1).tolist()
    last = max(len(words) - shingle_words, 0)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in
                       zip(starts[:last + 1], stops[min(shingle_words, len(words)) - 1:], strict=True)], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        bits = np.unpackbits(hashes[at:at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle_words: int = SHINGLE_WORDS, digest: Column | None = None) -> DataFrame:
    """(``doc_id``, ``fp``, ``digest``) per row; ``fp`` is the fingerprint as a signed long, ``digest`` what was given."""
    digest = F.lit(None) if digest is None else digest
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), digest.cast("string").alias("digest"))

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = np.array([fingerprint(text, shingle_words) for text in batch["text"]], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": values.view(np.int64), "digest": batch["digest"]})

    return rows.mapInPandas(compute, f"doc_id {dict(rows.dtypes)['doc_id']}, fp bigint, digest string")


class Block:
    """A perfect cyclic code on some bits: home codeword of a value, and the codewords in reach of it."""

    def __init__(self, code: tuple[int, int, int], reach: int):
        self.length, generator, self.radius = code
        self.checks = generator.bit_length() - 1
        size = self.length - self.checks
        remainders = np.array([self._remainder(1 << i, generator) for i in range(self.length)], dtype=np.uint32)
        bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
        #: Syndrome of every byte at every byte position; a value's syndrome is the XOR of those of its bytes.
        self.tables = []
        for at in range(0, self.length, 8):
            part = np.zeros(256, dtype=np.uint32)
            for i in range(min(8, self.length - at)):
                part ^= np.where(bits[:, i] == 1, remainders[at + i], 0).astype(np.uint32)
            self.tables.append(part)
        self.leaders = np.zeros(1 << self.checks, dtype=np.uint32)
        for weight in range(1, self.radius + 1):
            for places in combinations(range(self.length), weight):
                value = sum(1 << i for i in places)
                self.leaders[self.syndromes(np.array([value], dtype=np.uint32))[0]] = value
        messages = np.arange(1 << size, dtype=np.uint32) << self.checks
        codewords = messages ^ self.syndromes(messages)
        # Codewords (relative to home) by syndrome and by how far they exceed the radius.
        self.offsets: list[np.ndarray] = []
        starts = np.zeros((reach + 1, (1 << self.checks) + 1), dtype=np.int64)
        found: list[list[np.ndarray]] = [[] for _ in range(reach + 1)]
        for syndrome, leader in enumerate(self.leaders):
            weight = np.bitwise_count(codewords ^ leader).astype(int)
            excess = np.maximum(weight - self.radius, 0)
            for level in range(reach + 1):
                hit = codewords[excess == level]
                found[level].append(hit)
                starts[level, syndrome + 1] = len(hit)
        self.starts = np.cumsum(starts, axis=1)
        self.offsets = [np.concatenate(level) for level in found]

    @staticmethod
    def _remainder(value: int, generator: int) -> int:
        while value.bit_length() >= generator.bit_length():
            value ^= generator << (value.bit_length() - generator.bit_length())
        return value

    def syndromes(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values), dtype=np.uint32)
        for i, table in enumerate(self.tables):
            out ^= table[(values >> np.uint32(8 * i)) & np.uint32(255)]
        return out


@lru_cache(maxsize=4)
def _blocks(codes: tuple, threshold: int) -> tuple[Block, ...]:
    return tuple(Block(code, threshold) for code in codes)


def visits(fps: np.ndarray, codes: tuple = BLOCKS, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home anchor of each fingerprint, index of the visitor, visited anchor above its home)."""
    blocks = _blocks(codes, threshold)
    values, syndromes = [], []
    at = 0
    home = np.zeros(len(fps), dtype=np.uint64)
    for block in blocks:
        value = ((fps >> np.uint64(at)) & np.uint64((1 << block.length) - 1)).astype(np.uint32)
        syndrome = block.syndromes(value)
        nearest = value ^ block.leaders[syndrome]
        home |= nearest.astype(np.uint64) << np.uint64(at)
        values.append(nearest)
        syndromes.append(syndrome)
        at += block.length
    who, where = [], []
    for levels in product(range(threshold + 1), repeat=len(blocks)):
        if sum(levels) > threshold:
            continue
        index = np.arange(len(fps))
        anchor = np.zeros(len(fps), dtype=np.uint64)
        at = 0
        for block, level, nearest, syndrome in zip(blocks, levels, values, syndromes, strict=True):
            own = syndrome[index]
            first = block.starts[level, own]
            many = block.starts[level, own + 1] - first
            spread = np.repeat(np.arange(len(index)), many)
            within = np.arange(len(spread)) - np.repeat(np.cumsum(many) - many, many)
            code = block.offsets[level][first[spread] + within]
            index, anchor = index[spread], anchor[spread]
            anchor = anchor | ((nearest[index] ^ code).astype(np.uint64) << np.uint64(at))
            at += block.length
        above = anchor > home[index]
        who.append(index[above])
        where.append(anchor[above])
    return home, np.concatenate(who), np.concatenate(where)


def _meetings(fps: DataFrame, codes: tuple, threshold: int) -> DataFrame:
    """(``anchor``, ``at_home``, ``fp``): every fingerprint at its home and at the anchors it visits."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(every), 2048):
                own = every[at:at + 2048]
                home, who, where = visits(own.view(np.uint64), codes, threshold)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([home, where]).view(np.int64)),
                    pa.array(np.arange(len(home) + len(where)) < len(home)),
                    pa.array(np.concatenate([own, own[who]])),
                ], names=["anchor", "at_home", "fp"])

    return fps.select("fp").mapInArrow(spread, "anchor bigint, at_home boolean, fp bigint")


def _compare(threshold: int):
    """Links inside each (anchor, chunk) of a sorted partition, as a forest."""

    def near(fps: np.ndarray, homes: np.ndarray, others: np.ndarray) -> np.ndarray:
        return np.bitwise_count(fps[homes] ^ fps[others]) <= threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        held: tuple[np.ndarray, ...] | None = None

        def emit():
            rows = forest.drain()
            a, b = (np.array(rows, dtype=np.int64).reshape(-1, 2).T if rows else np.zeros((2, 0), dtype=np.int64))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        def take(keys: np.ndarray, chunks: np.ndarray, home: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, ...]:
            new = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (chunks[1:] != chunks[:-1])])
            sizes = np.diff(np.r_[new, len(keys)])
            homes = np.add.reduceat(home.astype(np.int64), new)
            unsigned = fps.view(np.uint64)
            busy = np.flatnonzero((homes > 0) & (sizes > 1))
            work = homes[busy] * sizes[busy]
            for group in np.split(busy, np.flatnonzero(np.diff(np.cumsum(work) // PAIRS_AT_ONCE)) + 1):
                if not len(group):
                    continue
                # Every member of a run against every home of it; a hot run goes by slices of its members.
                member = np.repeat(np.arange(len(group)), sizes[group])
                rows = np.arange(len(member)) - np.repeat(np.cumsum(sizes[group]) - sizes[group], sizes[group]) + new[group][member]
                step = max(1, int(PAIRS_AT_ONCE // max(1, homes[group].max())))
                for at in range(0, len(rows), step):
                    part, owner = rows[at:at + step], member[at:at + step]
                    many = homes[group][owner]
                    other = np.repeat(part, many)
                    start = np.repeat(new[group][owner], many)
                    one = start + np.arange(len(other)) - np.repeat(np.cumsum(many) - many, many)
                    hit = (one != other) & near(unsigned, one, other)
                    one, other = one[hit], other[hit]
                    # A member links to its first home; homes link where they follow one another for some member.
                    follows = other[1:] == other[:-1]
                    chain = np.unique(one[:-1][follows] * len(fps) + one[1:][follows])
                    first = np.r_[True, ~follows][:len(one)]
                    ends = (np.r_[one[first], chain // len(fps)], np.r_[other[first], chain % len(fps)])
                    for a, b in zip(fps[ends[0]].tolist(), fps[ends[1]].tolist(), strict=True):
                        forest.link(a, b)
            last = slice(new[-1], new[-1] + homes[-1])
            return keys[last], chunks[last], home[last], fps[last]

        def full(waiting):
            columns = [np.concatenate([batch.column(i).to_numpy(zero_copy_only=False) for batch in waiting]) for i in range(4)]
            columns[2] = columns[2].astype(bool)
            if held is not None:
                columns = [np.concatenate([old, column]) for old, column in zip(held, columns, strict=True)]
            return take(*columns)

        waiting, rows = [], 0
        for batch in batches:
            waiting.append(batch)
            rows += batch.num_rows
            if rows >= 100_000:
                held, waiting, rows = full(waiting), [], 0
                if len(forest.parent) > FOREST_NODES:
                    yield emit()
        if rows:
            full(waiting)
        yield emit()

    return run


def links(fps: DataFrame, codes: tuple = BLOCKS, threshold: int = THRESHOLD, home_limit: int = HOME_LIMIT) -> DataFrame:
    """A spanning forest (``a``, ``b``) of all links between distinct fingerprints at most ``threshold`` bits apart."""
    meetings = _meetings(fps, codes, threshold)
    homes = _meetings(fps, codes, threshold).where("at_home").groupBy("anchor").count().where(f"count > {home_limit}")
    hot = stage(homes.select("anchor", F.ceil(F.col("count") / home_limit).cast("int").alias("chunks")), "hot-anchors")
    split = meetings.join(hot, "anchor", "left")
    own = F.pmod(F.xxhash64("fp"), F.coalesce("chunks", F.lit(1))).cast("int")
    split = split.select(
        "anchor", "fp", F.when(F.col("at_home"), own).alias("own"),
        F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)).alias("chunk"))
    home_here = F.coalesce(F.col("own") == F.col("chunk"), F.lit(False))
    runs = split.select("anchor", "chunk", home_here.alias("at_home"), "fp").repartition("anchor", "chunk")
    runs = runs.sortWithinPartitions("anchor", "chunk", F.desc("at_home"))
    return runs.mapInArrow(_compare(threshold), "a bigint, b bigint")


def members(prints: DataFrame, codes: tuple = BLOCKS, threshold: int = THRESHOLD) -> DataFrame:
    """Staged fingerprints with the ``root`` of their component and its ``component_id``, null where no row has an id."""
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    member = components(links(distinct, codes, threshold))
    rooted = stage(distinct.join(member, distinct["fp"] == member["node"], "left")
                   .select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "rooted")
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return prints.join(rooted.join(ids, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS,
                    threshold: int = THRESHOLD, codes: tuple = BLOCKS) -> DataFrame:
    """(``doc_id``, ``fingerprint`` in 16 hex digits, ``component_id``) per row.

    Components join documents over chains of links of at most ``threshold`` differing bits; the id of a component is
    its smallest doc_id. Fingerprints are compared once however many documents share them.

    * null, empty and white-space texts have fingerprint zero and link like any other
    * texts of fewer words than a shingle are one shingle; long ones are read whole
    * repeated rows come back as often as they occur, in one component
    * an empty table gives an empty result; other columns, whatever their names, are not read
    """
    found = members(stage(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints"), codes, threshold)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with the smallest id of their component, with all their columns.

    Of rows that repeat an id those with different texts all stay if one of them is first in its component; of those
    with equal texts (white space aside) one stays. A row without id is later than any with one; of a component whose
    rows all lack an id one row stays, that with the smallest digest.
    """
    column, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    digest = F.sha2(F.encode(squeezed(text), "UTF-8"), 256)
    member = stage(members(stage(fingerprints(docs, id_col, text_col, digest=F.when(column.isNull(), digest)), "fingerprints")), "members")
    ids = member.where("doc_id is not null").groupBy("doc_id").agg(
        F.min(F.col("doc_id") != F.col("component_id")).alias("later"), F.count("*").alias("rows"))
    ids = stage(ids.where("later or rows > 1"), "near-copies")
    gone = ids.where("later").select(F.col("doc_id").alias("__gone_id"))
    left = docs.where(column.isNotNull()).join(merged(gone), column == F.col("__gone_id"), "left_anti")
    again = ids.where("not later and rows > 1").select(F.col("doc_id").alias("__again_id"))
    named = one_of_equal(left, again, id_col, text_col)

    chosen = member.where("doc_id is null and component_id is null").groupBy("root").agg(F.min("digest").alias("__chosen"))
    chosen = stage(chosen.select("__chosen"), "nameless")
    if chosen.isEmpty():
        return named
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    nameless = docs.where(column.isNull()).withColumn("__digest", digest).join(merged(chosen), F.col("__digest") == F.col("__chosen"), "left_semi")
    once = nameless.groupBy("__digest").agg(F.max_by(row, F.coalesce(F.char_length(text), F.lit(0))).alias("__row")).select("__row.*")
    return named.unionByName(once)
