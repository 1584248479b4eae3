"""Pair every accepted call with its first result inside one file, in any line order.

Per (file, call id) the file is a sequence of three kinds of events:

* ``use``    an accepted call; it takes an early result if one waits, else it waits itself
             (replacing a call of the same id that is already waiting);
* ``void``   a skipped or refused call; it discards a waiting early result;
* ``result`` it closes a waiting call, else the first one waits as an early result.

Nearly every id is used once and never voided. Those ids need no sequence at all: the
first result by file position is the answer, and that is a constant-size aggregate that
combines before the shuffle, however hot the id is.

Only reused ids need their order. An event maps the three states an id can be in to three
states, and such maps compose: a block of events is summed up by where each start state
ends and which call or result is held then, blocks of a chunk by the composition of their
summaries, chunks of an id likewise. Walking down again gives every block the state it
starts in. A block holds a bounded number of events, so no task ever holds a whole id of
more events than that; an id of one block at most is walked through at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.session import lazy

KEYS = ["file", "call_id"]
POSITION = ["chunk", "line", "block"]
POSITION_TYPE = "struct<chunk: bigint, line: bigint, block: int>"

USE, VOID, RESULT = "use", "void", "result"
TAGS = [USE, VOID, RESULT]

IDLE, WAITING, EARLY = 0, 1, 2
# The state after each tag, by the state before: rows are states, columns tags.
AFTER = [WAITING, IDLE, EARLY, WAITING, WAITING, IDLE, IDLE, IDLE, EARLY]
# Events of one id that are folded as one array.
BLOCK_EVENTS = 256


def call_events(uses: DataFrame, results: DataFrame) -> DataFrame:
    """One narrow row per event: file, call_id, position, tag, call, result."""
    position = F.struct(*POSITION).cast(POSITION_TYPE).alias("pos")
    call_type = uses.schema["call"].dataType
    result_type = results.schema["result"].dataType
    left = uses.select(
        *KEYS,
        position,
        F.when(F.col("status") == "accepted", F.lit(USE)).otherwise(F.lit(VOID)).alias("tag"),
        F.when(F.col("status") == "accepted", F.col("call")).alias("call"),
        F.lit(None).cast(result_type).alias("result"),
    )
    right = results.select(
        *KEYS, position, F.lit(RESULT).alias("tag"), F.lit(None).cast(call_type).alias("call"), "result"
    )
    return left.unionByName(right)


def _by_id(events: DataFrame, stage: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    tag, pos = F.col("tag"), F.col("pos")
    return stage(
        events.groupBy(*KEYS).agg(
            F.count_if(tag == USE).alias("uses"),
            F.count_if(tag == VOID).alias("voids"),
            F.count_if(tag == RESULT).alias("results"),
            F.min(F.when(tag == USE, F.struct(pos, "call"))).alias("c"),
            F.min(F.when(tag == RESULT, F.struct(pos, "result"))).alias("r"),
            F.max(F.when(tag == VOID, pos)).alias("last_void"),
        ),
        "calls-by-id",
    )


def _as_pairs(per_id: DataFrame) -> DataFrame:
    return per_id.select(*KEYS, "c.call", "r.result", F.col("c.pos").alias("call_pos"), F.col("r.pos").alias("result_pos"))


def pair_calls(
    events: DataFrame, stage: Callable[[DataFrame, str], DataFrame] = lazy
) -> DataFrame:
    """(file, call_id, call, result, call_pos, result_pos); result is NULL while a call is open.

    ``events`` is the output of :func:`call_events`.
    """
    per_id = _by_id(events, stage)
    once = _as_pairs(per_id.where((F.col("uses") == 1) & (F.col("voids") == 0)))
    reused = per_id.where((F.col("uses") >= 1) & (F.col("uses") + F.col("voids") > 1))
    if stage is not lazy and reused.isEmpty():
        return once
    folded = _fold_by_size(events, reused, stage)
    left = folded.ends.where(F.col("state") == WAITING).select(
        *KEYS, "held.call", F.lit(None).cast(events.schema["result"].dataType).alias("result"),
        F.col("held.pos").alias("call_pos"), F.lit(None).cast(POSITION_TYPE).alias("result_pos"))
    return once.unionByName(folded.pairs).unionByName(left)


@dataclass(frozen=True)
class Carried:
    """Completed pairs, and the events an id is left with: a waiting call or an early result."""

    pairs: DataFrame
    left: DataFrame


def carry_calls(events: DataFrame, stage: Callable[[DataFrame, str], DataFrame] = lazy) -> Carried:
    """Pair what can be paired and keep what later events of the same ids will need.

    ``events`` may hold what an earlier call left. As long as the events of an id arrive in file order, feeding them
    in pieces gives the pairs of feeding them at once; a call and its only result may come in any order.
    """
    per_id = _by_id(events, stage)
    # A call that was never accepted only discards a result before it.
    refused = (F.col("uses") == 0) & (F.col("results") <= 1)
    simple = refused | ((F.col("uses") == 1) & (F.col("results") <= 1) & (F.col("voids") == 0))
    once = per_id.where(simple)
    call_type, result_type = events.schema["call"].dataType, events.schema["result"].dataType
    no_call, no_result = F.lit(None).cast(call_type).alias("call"), F.lit(None).cast(result_type).alias("result")
    waiting = once.where("uses = 1 and results = 0").select(*KEYS, "c.pos", F.lit(USE).alias("tag"), "c.call", no_result)
    early = once.where("uses = 0 and results = 1 and (last_void is null or r.pos >= last_void)").select(*KEYS, "r.pos", F.lit(RESULT).alias("tag"), no_call, "r.result")
    pairs, left = _as_pairs(once.where("uses = 1 and results = 1")), waiting.unionByName(early)
    # Voids alone leave nothing behind.
    reused = per_id.where(~simple & (F.col("uses") + F.col("results") > 0))
    if stage is not lazy and reused.isEmpty():
        return Carried(pairs, left)
    folded = _fold_by_size(events, reused, stage)
    held = folded.ends.where(F.col("state") != IDLE).select(
        *KEYS, "held.pos", F.when(F.col("state") == WAITING, USE).otherwise(RESULT).alias("tag"), "held.call", "held.result")
    return Carried(pairs.unionByName(folded.pairs), left.unionByName(held))


# --- ordered fold of reused ids -------------------------------------------------------

@dataclass(frozen=True)
class Folded:
    """Completed pairs of reused ids, and per id its last ``state`` with the event ``held`` in it."""

    pairs: DataFrame
    ends: DataFrame


class _Fold:
    """Column expressions over events ``(pos, code, call, result)`` and over summaries of blocks of them.

    A summary has, for each start state k, the state ``s<k>`` it ends in and the event ``h<k>`` held there. A held
    event of NULL in a state that holds one stands for whatever was held at the start.
    """

    def __init__(self, event_type: str):
        self.nothing = F.lit(None).cast(event_type)

    def _next(self, state: Column, held: Column, event: Column) -> tuple[Column, Column]:
        after = F.get(F.array(*map(F.lit, AFTER)), state * 3 + event["code"])
        # A call that waits and a first early result are held; whatever ends in the idle state holds nothing.
        takes = (event["code"] == TAGS.index(USE)) | ((event["code"] == TAGS.index(RESULT)) & (state == IDLE))
        return after, F.when(after != IDLE, F.when(takes, event).otherwise(held))

    def _summary(self, parts: list[tuple[Column, Column]]) -> Column:
        fields = [c for k, (state, held) in enumerate(parts) for c in (state.alias(f"s{k}"), held.alias(f"h{k}"))]
        return F.struct(*fields)

    def _start(self) -> Column:
        return self._summary([(F.lit(k), self.nothing) for k in (IDLE, WAITING, EARLY)])

    def of_events(self, events: Column) -> Column:
        return F.aggregate(events, self._start(), lambda ends, event: self._summary(
            [self._next(ends[f"s{k}"], ends[f"h{k}"], event) for k in (IDLE, WAITING, EARLY)]))

    @staticmethod
    def _through(state: Column, held: Column, ends: Column) -> tuple[Column, Column]:
        after = F.get(F.array(*[ends[f"s{k}"] for k in (IDLE, WAITING, EARLY)]), state)
        inside = F.get(F.array(*[ends[f"h{k}"] for k in (IDLE, WAITING, EARLY)]), state)
        return after, F.when(after != IDLE, F.coalesce(inside, held))

    def of_parts(self, parts: Column) -> Column:
        return F.aggregate(parts, self._start(), lambda ends, part: self._summary(
            [self._through(ends[f"s{k}"], ends[f"h{k}"], part["ends"]) for k in (IDLE, WAITING, EARLY)]))

    def walk(self, parts: Column, key: str, state: Column, held: Column, part_type: str) -> Column:
        """Struct of the state after all parts, what is held there, and the state each part starts in."""
        def step(at: Column, part: Column) -> Column:
            after, kept = self._through(at["state"], at["held"], part["ends"])
            entered = F.struct(part[key].alias(key), at["state"].alias("state"), at["held"].alias("held"))
            return F.struct(after.alias("state"), kept.alias("held"), F.concat(at["out"], F.array(entered)).alias("out"))

        start = F.struct(state.alias("state"), held.alias("held"), F.array().cast(part_type).alias("out"))
        return F.aggregate(parts, start, step)

    def block(self, events: Column, state: Column, held: Column, pair_type: str) -> Column:
        """Struct of the state after a block that starts in the given state, what is held there, and the pairs completed inside."""
        def pair(call: Column, result: Column) -> Column:
            return F.array(F.struct(call.alias("c"), result.alias("r")))

        def step(at: Column, event: Column) -> Column:
            after, kept = self._next(at["state"], at["held"], event)
            met = at["state"] * 3 + event["code"]
            out = F.when(met == WAITING * 3 + TAGS.index(RESULT), F.concat(at["out"], pair(at["held"], event))).when(
                met == EARLY * 3 + TAGS.index(USE), F.concat(at["out"], pair(event, at["held"]))).otherwise(at["out"])
            return F.struct(after.alias("state"), kept.alias("held"), out.alias("out"))

        start = F.struct(state.alias("state"), held.alias("held"), F.array().cast(pair_type).alias("out"))
        return F.aggregate(events, start, step)


def _coded(events: DataFrame) -> DataFrame:
    """The keys and the events as the structs that are folded."""
    code = F.array_position(F.array(*map(F.lit, TAGS)), F.col("tag")).cast("int") - 1
    return events.select(*KEYS, F.struct("pos", code.alias("code"), "call", "result").alias("event"))


def _pairs_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(*KEYS, "c.call", "r.result", F.col("c.pos").alias("call_pos"), F.col("r.pos").alias("result_pos"))


def _fold_by_size(events: DataFrame, reused: DataFrame, stage: Callable[[DataFrame, str], DataFrame]) -> Folded:
    """Exact pairing of the ``reused`` ids: those of one block in one step, longer ones by blocks."""
    size = F.col("uses") + F.col("voids") + F.col("results")
    short = fold_short(events.join(reused.where(size <= BLOCK_EVENTS).select(*KEYS), KEYS, "left_semi"), stage)
    long = reused.where(size > BLOCK_EVENTS).select(*KEYS)
    if stage is not lazy and long.isEmpty():
        return short
    blocks = fold_reused(events.join(long, KEYS, "left_semi"), stage)
    return Folded(short.pairs.unionByName(blocks.pairs), short.ends.unionByName(blocks.ends))


def fold_short(events: DataFrame, stage: Callable[[DataFrame, str], DataFrame] = lazy) -> Folded:
    """Exact pairing for ids of at most ``BLOCK_EVENTS`` events each, a bounded array per id."""
    coded = _coded(events)
    event_type = coded.schema["event"].dataType.simpleString()
    fold = _Fold(event_type)
    whole = coded.groupBy(*KEYS).agg(F.sort_array(F.collect_list("event")).alias("events"))
    through = fold.block(F.col("events"), F.lit(IDLE), fold.nothing, f"array<struct<c: {event_type}, r: {event_type}>>")
    walks = stage(whole.select(*KEYS, through.alias("walk")), "reused-calls")
    # Events without a chunk come first and change the state, but blocks give no pair that is completed among them; nor does this.
    placed = walks.select(*KEYS, F.inline("walk.out")).where("c.pos.chunk is not null or r.pos.chunk is not null")
    return Folded(_pairs_of(placed), walks.select(*KEYS, "walk.state", "walk.held"))


def fold_reused(events: DataFrame, stage: Callable[[DataFrame, str], DataFrame] = lazy) -> Folded:
    """Exact pairing for ids that occur more than once, in any mixture of calls, voids and results."""
    chunk = F.col("event.pos.chunk")
    rank = F.row_number().over(Window.partitionBy(*KEYS, chunk).orderBy("event.pos"))
    numbered = _coded(events).select(*KEYS, chunk.alias("chunk"), "event", F.floor((rank - 1) / BLOCK_EVENTS).cast("int").alias("part"))
    event_type = numbered.schema["event"].dataType.simpleString()
    fold = _Fold(event_type)
    by_chunk = [*KEYS, "chunk"]
    blocks = stage(
        numbered.groupBy(*by_chunk, "part").agg(F.sort_array(F.collect_list("event")).alias("events"))
        .withColumn("ends", fold.of_events(F.col("events"))),
        "reused-calls",
    )
    chunks = blocks.groupBy(*by_chunk).agg(F.sort_array(F.collect_list(F.struct("part", "ends"))).alias("parts"))
    summed = chunks.select(*by_chunk, fold.of_parts(F.col("parts")).alias("ends"))
    ids = summed.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("chunk", "ends"))).alias("chunks"))
    walked = fold.walk(F.col("chunks"), "chunk", F.lit(IDLE), fold.nothing,
                       f"array<struct<chunk: bigint, state: int, held: {event_type}>>")
    walks = stage(ids.select(*KEYS, walked.alias("walk")), "reused-states")
    into_chunks = walks.select(*KEYS, F.inline("walk.out"))
    inside = fold.walk(F.col("parts"), "part", F.col("state"), F.col("held"),
                       f"array<struct<part: int, state: int, held: {event_type}>>")
    into_blocks = chunks.join(into_chunks, by_chunk).select(*by_chunk, inside.alias("walk")).select(*by_chunk, F.inline("walk.out"))
    completed = fold.block(F.col("events"), F.col("state"), F.col("held"), f"array<struct<c: {event_type}, r: {event_type}>>")["out"]
    pairs = blocks.join(into_blocks, [*by_chunk, "part"]).select(*KEYS, F.inline(completed))
    return Folded(_pairs_of(pairs), walks.select(*KEYS, "walk.state", "walk.held"))


def first_results(results: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First result per call id in file order; a constant-size aggregate per id."""
    rest = [c for c in results.columns if c not in keys and c not in order]
    return results.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("first")).select(*keys, "first.*")
