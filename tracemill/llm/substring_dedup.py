"""Substring deduplication on content-defined chunks.

A gear hash rolls over the bytes of a text (white space counts as one space); a chunk ends where the hash of the
last sixteen bytes is small and no other such place lies in the few bytes before it. Both conditions look at nearby
bytes only, so an insertion moves the cuts around it and no others, and a passage is cut alike wherever it stands.
Chunks are deduplicated by digest: one combining aggregate finds digests that occur in several documents, a join that
adaptive execution can split brings them back to their places, and neighbouring repeated chunks of a document become
one run.

Chunks of a run may come from many documents, so each window of neighbouring chunks with ``min_words`` words is compared
as a whole: those that another document holds are repeated. Where no window confirms a stretch of ``try_words`` words or
more, or an earlier document holds its chunks than its windows, it may be the inside of a repeated passage whose ends
are no whole chunks: an exact check compares the windows of ``min_words`` words around it. Windows in a row with the
same first holder are one span. A digest has 64 bits; a false window would take a collision.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import merged, stage

#: One in CUT_ONE_IN places is a possible cut; chunks shorter than MIN_CHUNK or longer than MAX_CHUNK bytes do not occur
#: (but for the ends of a text).
CUT_ONE_IN, MIN_CHUNK, MAX_CHUNK = 12, 12, 256
#: Words of a repeated span: of a passage of over 50 words this much is left when the words at its ends touch others.
MIN_WORDS = 48
#: Words of a run that is worth the exact check: of a passage of 50, about 35 lie between its first and last own cut.
TRY_WORDS = 10
#: Orders chunks by the words before them, then by number: more than a text has chunks.
STEP = 2**31
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 7) & 0xFFFF for b in range(256)], dtype=np.uint16)
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """16-bit gear hash at every byte: the sum of the gear values of the last 16 bytes, each shifted by its age.

    Doubling the window four times gives the same numbers as rolling byte by byte.
    """
    out = GEAR[data]
    for width in (1, 2, 4, 8):
        out[width:] = out[width:] + (out[:-width] << np.uint16(width))
    return out


#: Odd, so that its powers have inverses modulo 2^64.
BASE = 0x9E3779B97F4A7C15
BYTE_CODES = np.array([xxhash.xxh64_intdigest(bytes([b]), 11) for b in range(256)], dtype=np.uint64)


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, from 0 on."""
    inverse = pow(BASE, -1, 1 << 64)
    return tuple(np.cumprod(np.r_[np.uint64(1), np.full(size - 1, base, dtype=np.uint64)]) for base in (BASE, inverse))


def stretch_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the stretches of ``codes`` from each start to its end: polynomials as differences of one running sum."""
    powers, inverse = _powers(1 << max(10, int(len(codes)).bit_length()))
    sums = np.r_[np.uint64(0), np.cumsum(codes * powers[:len(codes)], dtype=np.uint64)]
    value = (sums[ends] - sums[starts]) * inverse[starts]
    value = (value ^ (value >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return value ^ (value >> np.uint64(29))


def cuts(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks of a non-empty text, in order; the last is its length. Never inside a character."""
    possible = np.flatnonzero(gear_hashes(data) < 65536 // CUT_ONE_IN) + 1
    ends = possible[np.diff(possible, prepend=-MIN_CHUNK) >= MIN_CHUNK]
    for _ in range(3):  # past the continuation bytes of a character
        inside = ends < len(data)
        ends = ends + (inside & ((data[np.minimum(ends, len(data) - 1)] & 0xC0) == 0x80))
    ends = np.unique(np.r_[ends[ends < len(data)], len(data)])
    starts = np.r_[0, ends[:-1]]
    if (ends - starts).max(initial=0) > MAX_CHUNK:
        parts = [np.r_[np.arange(a + MAX_CHUNK, b, MAX_CHUNK), b] for a, b in zip(starts, ends, strict=True)]
        ends = np.concatenate(parts)
        for _ in range(3):
            inside = ends < len(data)
            ends = ends + (inside & ((data[np.minimum(ends, len(data) - 1)] & 0xC0) == 0x80))
        ends = np.unique(ends)
    return ends


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``doc_id``, ``digest``, ``chunk``, ``start``, ``stop``, ``words``) per chunk, in the order of ``chunk``.

    Places are bytes of the UTF-8 text, ``words`` counts the words that begin in the chunk. Texts without words have
    no chunks.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).where("text <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 128):
                owner, digests, columns = [], [], []
                for i in range(at, min(at + 128, batch.num_rows)):
                    data = np.frombuffer(texts[i].as_buffer(), dtype=np.uint8)
                    space = SPACE[data]
                    # Each run of white space shrinks to its first byte, one at the start to nothing.
                    place = np.flatnonzero(~space | np.r_[False, ~space[:-1]])
                    if not len(place):
                        continue
                    plain, space = data[place], space[place]
                    plain[space] = 32
                    ends = cuts(plain)
                    begins = np.r_[0, ends[:-1]]
                    raw = plain.tobytes()
                    digests += [digest(raw[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                    owner.append(np.full(len(ends), i))
                    first = ~space & np.r_[True, space[:-1]]
                    columns.append(np.stack([np.arange(len(ends)), place[begins], place[ends - 1] + 1,
                                             np.add.reduceat(first.astype(np.int64), begins)]).astype(np.int32))
                if owner:
                    made = np.concatenate(columns, axis=1)
                    yield pa.RecordBatch.from_arrays([
                        ids.take(pa.array(np.concatenate(owner))), pa.array(np.array(digests, dtype=np.uint64).view(np.int64)),
                        *map(pa.array, made)], names=["doc_id", "digest", "chunk", "start", "stop", "words"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, digest bigint, chunk int, start int, stop int, words int")


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """Keys that several documents hold, with the first of them."""
    held = rows.groupBy(key).agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last_doc_id"))
    return held.where("first_doc_id <> last_doc_id").select(key, "first_doc_id")


def _islands(rows: DataFrame, at: str, reach: int, same: str | None = None) -> DataFrame:
    """Rows of a document whose ``at`` follows the one before by at most ``reach``, numbered as one ``island``.

    An island ends where ``same`` changes. The window is one document's rows, bounded by its length.
    """
    order = Window.partitionBy("doc_id").orderBy(at)
    apart = F.col(at) - F.lag(at).over(order) > reach
    if same is not None:
        apart = apart | (F.col(same) != F.lag(same).over(order))
    return rows.withColumn("fresh", F.coalesce(apart.cast("int"), F.lit(1))).withColumn("island", F.sum("fresh").over(order))


def _chunk_windows(places: DataFrame, words: int) -> DataFrame:
    """Adds to each chunk the window of neighbouring chunks that starts there and first holds ``words`` words.

    ``before`` and ``upto`` are the words of the run before the window and up to its end, ``reach`` is its last byte;
    ``hash`` is that of no other document where the run ends too early.
    """
    run = Window.partitionBy("doc_id", "island")
    before = F.sum("words").over(run.orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    ahead = run.orderBy("place").rangeBetween(0, words * STEP - 1)
    return places.withColumn("before", before).withColumn("place", F.col("before") * STEP + F.col("chunk")).withColumns({
        "upto": F.max(F.col("before") + F.col("words")).over(ahead), "reach": F.max("stop").over(ahead),
        "digests": F.collect_list("digest").over(ahead),
    }).withColumn("whole", F.col("upto") - F.col("before") >= words).withColumn(
        "hash", F.when(F.col("whole"), F.xxhash64("digests")).otherwise(F.xxhash64("doc_id", "chunk")))


def _confirmed(places: DataFrame, words: int, try_words: int) -> DataFrame:
    """Adds the ``holder`` of each window that several documents hold, its ``part`` and whether the chunk is ``doubtful``.

    Windows in a row with one holder are one part. Doubtful are stretches of ``try_words`` words that no window
    confirms, or whose chunks an earlier document holds than their windows.
    """
    held = _shared(places.where("whole"), "hash").withColumnRenamed("first_doc_id", "holder")
    # Only whole windows are shared: the other hashes are there to deal their rows out evenly.
    rows = places.join(held, "hash", "left").withColumn("holder", F.when(F.col("whole"), F.col("holder")))
    order = Window.partitionBy("doc_id").orderBy("chunk")
    covering = Window.partitionBy("doc_id", "island").orderBy("place").rangeBetween(1 - words * STEP, 0)
    cover = F.min("holder").over(covering)
    rows = rows.withColumn("place", F.col("before") * STEP + F.col("chunk")).withColumn(
        "open", cover.isNull() | (F.col("first_doc_id") < cover))
    follows = F.col("chunk") - F.lag("chunk").over(order) <= 1
    goes_on = follows & F.col("holder").eqNullSafe(F.lag("holder").over(order))
    stays = follows & (F.col("open") == F.lag("open").over(order))
    number = lambda on: F.sum(F.when(on, 0).otherwise(1)).over(order)
    rows = rows.withColumn("part_on", goes_on).withColumn("stretch_on", stays)
    rows = rows.withColumn("part", number(F.col("part_on"))).withColumn("stretch", number(F.col("stretch_on")))
    long = F.sum("words").over(Window.partitionBy("doc_id", "stretch")) >= try_words
    return rows.withColumn("doubtful", F.col("open") & long)


def _span_columns(stop: str, holder: str) -> list:
    return [F.min("start").alias("start"), F.max(stop).alias("stop"), F.first(holder).alias("first_doc_id"),
            F.first(F.col(holder) == F.col("doc_id")).alias("is_first")]


def _windows(docs: DataFrame, doubtful: DataFrame, words: int) -> DataFrame:
    """(``doc_id``, ``hash``, ``word``, ``start``, ``stop``): the windows of ``words`` words that meet doubtful places."""
    runs = doubtful.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("runs"))
    runs = runs.withColumnRenamed("doc_id", "__id")
    rows = docs.join(merged(runs), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "runs")

    def of(raw: bytes, places) -> tuple[np.ndarray, ...] | None:
        data = np.frombuffer(raw, dtype=np.uint8)
        space = SPACE[data]
        starts = np.flatnonzero(~space & np.r_[True, space[:-1]])
        ends = np.flatnonzero(~space & np.r_[space[1:], True]) + 1
        if len(starts) < words:
            return None
        wanted = np.zeros(len(starts) - words + 1, dtype=bool)
        for place in places:
            first = int(np.searchsorted(ends, place["start"], side="right"))
            last = int(np.searchsorted(starts, place["stop"])) - 1
            wanted[max(0, last - words + 1):max(0, first + 1)] = True
        at = np.flatnonzero(wanted)
        if not len(at):
            return None
        codes = stretch_hashes(BYTE_CODES[data], starts, ends)
        hashes = stretch_hashes(codes, at, at + words)
        return hashes.view(np.int64), at, starts[at], ends[at + words - 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["hash", "word", "start", "stop"]
        for batch in batches:
            owners, parts = [], []
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for row, (text, places) in enumerate(zip(texts, batch.column("runs").to_pylist(), strict=True)):
                found = of(text, places)
                if found is not None:
                    owners.append(np.full(len(found[0]), row))
                    parts.append(found)
            if parts:
                made = [np.concatenate(column) for column in zip(*parts, strict=True)]
                columns = [pa.array(made[0]), *(pa.array(column.astype(np.int32)) for column in made[1:])]
                owner = batch.column("doc_id").take(pa.array(np.concatenate(owners)))
                yield pa.RecordBatch.from_arrays([owner, *columns], names=["doc_id", *names])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, hash bigint, word int, start int, stop int")


def _documents(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """(``doc_id``, ``text``) of the rows, and whether ``doc_id`` had to become (absent, id, version of the text).

    It does where an id stands for several texts or is null: chunks of one text must not meet those of another.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    version = F.xxhash64("text")
    several = rows.groupBy("doc_id").agg(F.min(version).alias("low"), F.max(version).alias("high")).where("doc_id is null or low <> high")
    if several.isEmpty():
        return rows, False
    return rows.select(_versioned(F.col("doc_id"), F.col("text")).alias("doc_id"), "text"), True


def _versioned(doc_id: Column, text: Column) -> Column:
    return F.struct(doc_id.isNull().alias("absent"), doc_id.alias("id"), F.xxhash64(text).alias("version"))


def _spans(rows: DataFrame, min_words: int, try_words: int) -> DataFrame:
    """The spans of ``repeated_spans`` over (``doc_id``, ``text``)."""
    pieces = chunks(rows)
    shared = stage(_shared(pieces, "digest"), "shared-chunks")
    places = _islands(pieces.join(shared, "digest").distinct(), "chunk", 1)
    run_words = F.sum("words").over(Window.partitionBy("doc_id", "island"))
    places = places.withColumn("n_words", run_words).where(F.col("n_words") >= try_words)
    places = stage(_chunk_windows(places, min_words).drop("fresh", "n_words", "place", "digests"), "places")
    known = stage(_confirmed(places, min_words, try_words).where("holder is not null or doubtful").select(
        "doc_id", "digest", "start", "reach", "before", "upto", "holder", "part", "doubtful"), "confirmed")
    runs = known.where("holder is not null").groupBy("doc_id", "part").agg(
        *_span_columns("reach", "holder"), (F.max("upto") - F.min("before")).alias("n_words")).drop("part")

    # Wherever doubtful chunks stand: there may be the other copy.
    doubtful = places.join(known.where("doubtful").select("digest").distinct(), "digest", "left_semi")
    windows = stage(_windows(rows, doubtful, min_words), "windows")
    again = windows.join(_shared(windows, "hash"), "hash").drop("hash").distinct()
    checked = _islands(again, "word", min_words, "first_doc_id").groupBy("doc_id", "island").agg(
        *_span_columns("stop", "first_doc_id"), (F.max("word") - F.min("word") + min_words).cast("long").alias("n_words")).drop("island")
    return runs.unionByName(checked)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                   try_words: int = TRY_WORDS) -> DataFrame:
    """Spans of text that other documents share: ``doc_id, start, stop, n_words, first_doc_id, is_first``.

    Each window of ``min_words`` words (or of chunks with that many) has a first holder, the smallest id that holds it
    as a whole; a span is a row of windows with one first holder, ``first_doc_id``. ``is_first`` marks the spans that no
    document with a smaller id holds: the occurrence that stays. Where the first holder changes, the spans on both sides
    overlap by less than a window.

    * null and empty texts have no spans; whole texts are cut, however long; white space does not matter
    * text that repeats within one document only is no span; ties go to the smaller id
    * rows that repeat an id with one text are one document, with different texts several; so are rows without id, which
      come after all others; their ``doc_id`` and ``first_doc_id`` come out as they are
    * an empty table gives an empty result; other columns, whatever their names, are not read
    """
    rows, versions = _documents(docs, id_col, text_col)
    spans = _spans(rows, min_words, try_words)
    return spans.withColumns({c: F.col(f"{c}.id") for c in ("doc_id", "first_doc_id")}) if versions else spans


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                   try_words: int = TRY_WORDS) -> DataFrame:
    """The documents, all columns, without the spans that an earlier document holds; texts may become empty.

    Rows are told apart as in :func:`repeated_spans`: those of one id with different texts, or without id, each lose what
    they themselves share with an earlier one.
    """
    rows, versions = _documents(docs, id_col, text_col)
    spans = _spans(rows, min_words, try_words).where(~F.col("is_first"))
    gone = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("__gone"))
    gone = stage(gone.withColumnRenamed("doc_id", "__gone_id"), "repeats")

    @F.pandas_udf("string")
    def rest(text: pd.Series, places: pd.Series) -> pd.Series:
        out = []
        for value, found in zip(text, places, strict=True):
            if found is not None and len(found) and value:
                raw, kept, at = value.encode(), [], 0
                for span in sorted(found, key=lambda s: s["start"]):
                    kept.append(raw[at:span["start"]])
                    at = max(at, span["stop"])
                value = b"".join([*kept, raw[at:]]).decode()
            out.append(value)
        return pd.Series(out)

    own = F.col(f"`{id_col}`")
    own = _versioned(own, F.col(f"`{text_col}`")) if versions else own
    joined = docs.join(merged(gone), own == F.col("__gone_id"), "left")
    return joined.withColumn(text_col, rest(F.col(f"`{text_col}`"), F.col("__gone"))).drop("__gone", "__gone_id")
