"""Phrase collocations by top-order marginalisation: longest windows are counted, ROLLUP gives all shorter phrases.

At each word of a piece stands one window of up to five words, in lead columns padded with nulls. Every contiguous
phrase is the beginning of exactly one window per occurrence, so the counts of the distinct padded windows, summed by
ROLLUP over ever shorter prefixes, are the counts of all phrases of one to five words, and the total is the number of
words. No phrase length is exploded on its own.

Windows are padded as early as they can be without losing a phrase that is frequent enough: before them, runs of two
words, then runs of three words of which both pairs are left, are counted by hash bucket, and a window ends where the
next run's bucket holds too few. A bucket that several runs share only lets a window grow longer than it
need; the counts that decide are exact. The buckets are bitmaps of fixed size, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import merged, stage

MAX_WORDS, MIN_COUNT, TOP = 5, 100, 2000
#: Share of a phrase's occurrences, in percent, that a longer phrase must cover to replace it.
COVERED_PERCENT = 100
#: Buckets of a bitmap as a power of two (16 MB each); 15 at least.
BUCKET_BITS = 27

BREAKS = b".,;:!?\n\x0b\x0c\r"
#: A-Z counts as a-z; breaks become line ends, tabs become spaces.
TEXT_BYTES = bytes(0x0A if b in BREAKS else 0x20 if b == 0x09 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Rows of a bitmap hold this many bits.
BITMAP_ROW = 32768


def pieces(text: bytes | None) -> Iterator[list[bytes]]:
    """Words of every piece of a text that has any."""
    for piece in text.translate(TEXT_BYTES).split(b"\n") if text else ():
        found = piece.split()
        if found:
            yield found


def _mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hash of two hashes."""
    value = first * np.uint64(0x9E3779B97F4A7C15) + (second ^ (second >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (value ^ (value >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


class Words:
    """The words of a batch of texts in one language as numbers, a gap of -1 after each piece."""

    def __init__(self, lang: str, texts: list[bytes | None]):
        self.lang = lang
        numbers: dict[bytes, int] = {}
        flat: list[int] = []
        for text in texts:
            for piece in pieces(text):
                flat.extend([numbers.setdefault(word, len(numbers)) for word in piece])
                flat.append(-1)
        self.words = list(numbers)
        self.flat = np.array(flat, dtype=np.int64)
        seed = xxhash.xxh32_intdigest(lang.encode())
        self.hashes = np.array([xxhash.xxh64_intdigest(word, seed) for word in self.words] or [0], dtype=np.uint64)

    def runs(self, size: int, bits: int) -> np.ndarray:
        """Bucket of the run of ``size`` words from each place; -1 where a gap or the end comes first."""
        whole = self.flat >= 0
        value = self.hashes[self.flat]
        for step in range(1, size):
            whole = whole & np.append(self.flat[step:] >= 0, [False] * step)
            value = _mixed(value, np.append(self.hashes[self.flat[step:]], np.zeros(step, dtype=np.uint64)))
        return np.where(whole, (_mixed(value, np.uint64(size)) >> np.uint64(64 - bits)).astype(np.int64), -1)

    def frequent(self, size: int, bits: int, bitmaps: dict[int, np.ndarray]) -> np.ndarray:
        """Whether the run of ``size`` words from each place may be frequent enough."""
        buckets = self.runs(size, bits)
        return (buckets >= 0) & ((bitmaps[size][buckets >> 3] >> (buckets & 7).astype(np.uint8)) & 1).astype(bool)

    def windows(self, bitmaps: dict[int, np.ndarray], size: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct windows (rows of word numbers, -1 for padding) and how often each stands here."""
        pair, triple = (np.append(self.frequent(n, bits, bitmaps), [False] * size) for n in (2, 3))
        flat = np.append(self.flat, [-1] * size)
        # Most windows are one word and padding: those are counted by word, only the others column by column.
        alone = np.bincount(self.flat[(self.flat >= 0) & ~pair[:len(self.flat)]], minlength=len(self.words))
        words = np.flatnonzero(alone)
        short = np.full((len(words), size), -1, dtype=np.int64)
        short[:, 0] = words
        at = np.flatnonzero(pair)
        going = np.ones(len(at), dtype=bool)
        columns, codes, count = [flat[at]], flat[at], len(self.words)
        for step in range(1, size):
            going = going & pair[at + step - 1]
            if step > 1:
                going = going & triple[at + step - 2]
            column = np.where(going, flat[at + step], -1)
            columns.append(column)
            # Windows equal so far have one code; only those that go on are told apart further.
            longer = np.flatnonzero(going)
            _, inner = np.unique(codes[longer] * np.int64(len(self.words)) + column[longer], return_inverse=True)
            codes[longer] = count + inner
            count += int(inner.max()) + 1 if len(inner) else 0
        counts = np.bincount(codes, minlength=count)
        example = np.zeros(count, dtype=np.int64)
        example[codes] = np.arange(len(at))
        used = np.flatnonzero(counts)
        long = np.stack([column[example[used]] for column in columns], axis=1)
        return np.concatenate([short, long]), np.concatenate([alone[words], counts[used]])


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        for lang in sorted(set(langs)):
            found = Words(lang, [text for text, of in zip(texts, langs, strict=True) if of == lang])
            if len(found.flat):
                yield found


def frequent_runs(texts: DataFrame, size: int, known: dict[int, np.ndarray], min_count: int, bits: int) -> np.ndarray:
    """Bits of the buckets that hold ``min_count`` runs of ``size`` words or more, packed from the lowest bit.

    Runs of three are counted only where both pairs may be frequent enough.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _by_language(batches):
            runs = found.runs(size, bits)
            if size == 3:
                pair = found.frequent(2, bits, known)
                runs = np.where(pair & np.append(pair[1:], False), runs, -1)
            bucket, n = np.unique(runs[runs >= 0], return_counts=True)
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(bucket, pa.int64()), "n": pa.array(n, pa.int64())})

    buckets = texts.mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    rows = buckets.groupBy((F.col("bucket") / BITMAP_ROW).cast("int").alias("row")).agg(
        F.bitmap_construct_agg(F.col("bucket") % BITMAP_ROW).alias("bits")).collect()
    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for row in rows:
        out[row.row * (BITMAP_ROW // 8):(row.row + 1) * (BITMAP_ROW // 8)] = np.frombuffer(bytes(row.bits), dtype=np.uint8)
    return out


def padded_windows(texts: DataFrame, bitmaps: dict[int, np.ndarray], size: int, bits: int) -> DataFrame:
    """``lang``, ``w1`` to ``w<size>`` (null for padding) and ``n``, added up within a batch."""
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _by_language(batches):
            rows, counts = found.windows(bitmaps, size, bits)
            words = pa.array(found.words, pa.binary()).cast(pa.string())
            columns = {f"w{i + 1}": words.take(pa.array(rows[:, i], mask=rows[:, i] < 0)) for i in range(size)}
            yield pa.RecordBatch.from_pydict({"lang": pa.array([found.lang] * len(counts), pa.string()), **columns, "n": pa.array(counts, pa.int64())})

    return texts.mapInArrow(windows, "lang string, " + ", ".join(f"w{i + 1} string" for i in range(size)) + ", n bigint")


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS,
                  min_count: int = MIN_COUNT, bucket_bits: int = BUCKET_BITS) -> DataFrame:
    """``lang``, ``size``, ``phrase`` and ``f`` of all phrases of up to ``max_words`` words with ``f >= min_count``.

    The row of size 0 of a language holds its number of words.
    """
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    bitmaps = {2: frequent_runs(texts, 2, {}, min_count, bucket_bits)}
    bitmaps[3] = frequent_runs(texts, 3, bitmaps, min_count, bucket_bits)
    lead = [f"w{i + 1}" for i in range(max_words)]
    top = padded_windows(texts, bitmaps, max_words, bucket_bits).groupBy("lang", *lead).agg(F.sum("n").alias("n"))
    sums = top.rollup("lang", *lead).agg(F.sum("n").alias("f"), F.grouping_id().alias("rolled"))
    # The columns that a level keeps are those of the phrase; a null among them is padding, whose count is no phrase.
    sizes = {(1 << (max_words - k)) - 1: k for k in range(max_words + 1)}
    size: Column = F.element_at(F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair]), F.col("rolled").cast("int"))
    whole = sums.where(F.col("rolled") < 1 << max_words).withColumn("size", size)
    last = F.element_at(F.array(F.lit(""), *lead), F.col("size") + 1)
    return whole.where(last.isNotNull() & ((F.col("size") == 0) | (F.col("f") >= min_count))).select(
        "lang", "size", F.concat_ws(" ", *lead).alias("phrase"), "f")


def _part(phrase: Column, first: Column, length: Column) -> Column:
    """Words of a phrase from number ``first`` (from 1)."""
    return F.concat_ws(" ", F.slice(F.split(phrase, " "), first, length))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT,
                 top: int = TOP, covered_percent: int = COVERED_PERCENT, bucket_bits: int = BUCKET_BITS) -> DataFrame:
    """The phrases of each language whose parts stand together most beyond chance.

    Candidates are phrases of two to ``max_words`` words that occur ``min_count`` times or more inside pieces (texts
    are split at ``. , ; : ! ?`` and line ends). Cut in two after k words, a candidate scores floor(1000 a n / (l r))
    by its count a, those of its parts l and r, and the language's number of words n; the cut that scores lowest counts,
    of equal ones the first. A candidate goes if a longer one that holds it has ``covered_percent`` of its count.

    Returns the first ``top`` of each language by score, count, then phrase: ``lang``, ``rank``, ``phrase``, ``a``,
    ``l``, ``r``, ``n``, ``score``.

    * a null text counts as empty, a null language as ``und``; repeated rows count each
    * pieces and texts may be of any length; no rows, or no phrase that is frequent enough: an empty result
    * other columns, whatever their names, are not read
    """
    counts = stage(phrase_counts(docs, text_col, lang_col, max_words, min_count, bucket_bits), "phrases")
    totals = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    phrases = counts.where("size > 0")
    candidates = phrases.where("size > 1").withColumnRenamed("f", "a")
    parts = phrases.select("lang", F.col("phrase").alias("part"), F.col("f").alias("count"))

    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumns({"head": _part(F.col("phrase"), F.lit(1), F.col("k")),
                             "tail": _part(F.col("phrase"), F.col("k") + 1, F.col("size") - F.col("k"))})
    cuts = cuts.join(merged(parts.withColumnsRenamed({"part": "head", "count": "l"})), ["lang", "head"])
    cuts = cuts.join(merged(parts.withColumnsRenamed({"part": "tail", "count": "r"})), ["lang", "tail"]).join(totals, "lang")
    # Products of counts pass 64 bits; decimals of 38 digits hold them.
    wide = [F.col(c).cast("decimal(19,0)").alias(c) for c in ("a", "n", "l", "r")]
    scored = cuts.select("lang", "phrase", "size", "k", *wide).withColumn("score", F.expr("(1000 * a * n) div (l * r)"))
    best = scored.groupBy("lang", "phrase", "size", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    longer = candidates.where("size > 2").withColumn("take", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    longer = longer.withColumn("first", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("take") + 1)))
    inside = longer.groupBy("lang", _part(F.col("phrase"), F.col("first"), F.col("take")).alias("phrase")).agg(F.max("a").alias("inside"))
    covered = F.coalesce(F.col("inside"), F.lit(0)).cast("decimal(19,0)") * 100 >= F.col("a") * covered_percent
    kept = best.join(merged(inside), ["lang", "phrase"], "left").where(~covered)

    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    flat = kept.select("lang", "phrase", F.col("cut.score").alias("score"), "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n")
    ranked = flat.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", *[F.col(c) if c == "phrase" else F.col(c).cast("long").alias(c) for c in ("rank", "phrase", "a", "l", "r", "n", "score")])
