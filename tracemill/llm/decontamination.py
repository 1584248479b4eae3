"""Benchmark decontamination: a generalised suffix automaton of the test items, streamed against by every document.

The automaton holds every run of words of every item, so following a document's words through it gives, at each word,
the longest run ending there that some item contains. A run of ``window`` words or more marks its words, and the state
of its last ``window`` words names the items; items shorter than a window mark where they occur whole.

Items are dealt by hash into blocks of a bounded number of words, one automaton a block; long items are cut into pieces
that overlap by ``window - 1`` words, so no window is lost. The documents pass one block after the other, without a
shuffle: a step carries what the blocks before it found. Only a block's words ever leave Spark, never the documents.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracemill.llm.common import stage

WINDOW = 10
#: Words of an automaton (about 100 MB each at this bound), words of a piece, automata in one stage.
BLOCK_WORDS, PIECE_WORDS, RESIDENT = 1 << 18, 4096, 4

#: Words are runs of digits, letters and everything beyond ASCII; A-Z counts as a-z.
WORD_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
                   for b in range(256))
WORD = re.compile(rb"[^ ]+")
FOUND = "array<struct<first: bigint, words: bigint>>"


def words(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class SuffixAutomaton:
    """All runs of words of some texts. State 0 is the empty run; a state stands for runs with the same ends."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.steps: list[dict[int, int]] = [{}]
        self.shorter, self.longest = [-1], [0]
        self.names: dict[int, set[str]] = {}
        self.whole: dict[int, dict[int, set[str]]] = {}
        self.alert: list[int] = []

    def _state(self, longest: int, steps: dict[int, int], shorter: int) -> int:
        self.longest.append(longest)
        self.steps.append(steps)
        self.shorter.append(shorter)
        return len(self.steps) - 1

    def _part(self, state: int, word: int, target: int) -> int:
        """The state for a run and ``word``; split from ``target`` if that also stands for longer runs."""
        if self.longest[target] == self.longest[state] + 1:
            return target
        twin = self._state(self.longest[state] + 1, dict(self.steps[target]), self.shorter[target])
        self.shorter[target] = twin
        while state >= 0 and self.steps[state].get(word) == target:
            self.steps[state][word] = twin
            state = self.shorter[state]
        return twin

    def add(self, text: list[bytes]) -> None:
        state = 0
        for word in text:
            word = self.vocabulary.setdefault(word, len(self.vocabulary))
            if word in self.steps[state]:
                state = self._part(state, word, self.steps[state][word])
                continue
            new, at = self._state(self.longest[state] + 1, {}, 0), state
            while at >= 0 and word not in self.steps[at]:
                self.steps[at][word] = new
                at = self.shorter[at]
            if at >= 0:
                self.shorter[new] = self._part(at, word, self.steps[at][word])
            state = new

    def close(self, items: list[tuple[str | None, list[bytes]]]) -> SuffixAutomaton:
        """Note at the states which items hold their window, then what length of a match matters at each state."""
        for name, text in items:
            state = length = 0
            for word in text:
                state, length = self._follow(state, length, self.vocabulary[word])
                # Longer matches than a window are cut back, so that the state is that of the window.
                while self.longest[self.shorter[state]] >= self.window:
                    state = self.shorter[state]
                    length = self.longest[state]
                if length >= self.window:
                    length = self.window
                    self._note(self.names.setdefault(state, set()), name)
            if 0 < len(text) < self.window:
                self._note(self.whole.setdefault(state, {}).setdefault(len(text), set()), name)
        self.alert = [1 << 60] * len(self.steps)
        self.home = list(range(len(self.steps)))
        for state in sorted(range(1, len(self.steps)), key=self.longest.__getitem__):
            up = self.shorter[state]
            own = min(self.whole.get(state, {1 << 60: None}))
            self.alert[state] = min(self.alert[up], own, self.window if self.longest[state] >= self.window else 1 << 60)
            if self.longest[up] >= self.window:
                self.home[state] = self.home[up]
        return self

    @staticmethod
    def _note(names: set[str], name: str | None) -> None:
        if name is not None:
            names.add(name)

    def _follow(self, state: int, length: int, word: int) -> tuple[int, int]:
        if word not in self.steps[state]:
            # The empty run goes on with every word of the vocabulary.
            while word not in self.steps[state]:
                state = self.shorter[state]
            length = self.longest[state]
        return self.steps[state][word], length + 1

    def trace(self, text: list[bytes]) -> tuple[list[list[int]], set[str], int]:
        """Marked spans of a text as [first, end), the items that mark them, and the longest match of any kind."""
        steps, shorter, longest, alert = self.steps, self.shorter, self.longest, self.alert
        spans: list[list[int]] = []
        states, names = set(), set()
        state = length = best = 0
        for at, word in enumerate(map(self.vocabulary.get, text)):
            if word is None:
                state = length = 0
                continue
            go = steps[state].get(word)
            if go is None:
                while word not in steps[state]:
                    state = shorter[state]
                length = longest[state]
                go = steps[state][word]
            state = go
            length += 1
            if length > best:
                best = length
            if length >= alert[state]:
                reach = 0
                if length >= self.window:
                    reach = length
                    states.add(self.home[state])
                up = state if self.whole else 0
                while up > 0:
                    for size, ids in self.whole.get(up, {}).items():
                        if size <= length:
                            reach = max(reach, size)
                            names |= ids
                    up = shorter[up]
                first = at + 1 - reach
                while spans and spans[-1][1] >= first:
                    first = min(first, spans.pop()[0])
                spans.append([first, at + 1])
        for state in states:
            names |= self.names[state]
        return spans, names, best


def build(items: list[tuple[str | None, bytes]], window: int) -> SuffixAutomaton:
    automaton = SuffixAutomaton(window)
    split = [(name, text.split()) for name, text in items]
    for _, text in split:
        automaton.add(text)
    return automaton.close(split)


def joined(*found: list[list[int]]) -> list[list[int]]:
    """Spans of several findings as one list of disjoint, not touching spans."""
    out: list[list[int]] = []
    for first, end in sorted(span for spans in found for span in spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(end, out[-1][1])
        else:
            out.append([first, end])
    return out


def item_pieces(benchmark: DataFrame, item_col: str, text_col: str, window: int, piece_words: int) -> DataFrame:
    """``item``, ``piece``, ``n`` and ``text`` (normalised words, spaces between) of the items that hold a word."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"item": [], "piece": [], "n": [], "text": []}
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                all_words = words(text)
                step = piece_words - window + 1
                for piece, first in enumerate(range(0, max(len(all_words) - window + 1, min(len(all_words), 1)), step)):
                    part = all_words[first:first + piece_words]
                    out["item"].append(item)
                    out["piece"].append(piece)
                    out["n"].append(len(part))
                    out["text"].append(b" ".join(part).decode())
            yield pa.RecordBatch.from_pydict({"item": pa.array(out["item"], pa.string()), "piece": pa.array(out["piece"], pa.int64()),
                                              "n": pa.array(out["n"], pa.int64()), "text": pa.array(out["text"], pa.string())})

    rows = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(cut, "item string, piece bigint, n bigint, text string")


def _step(block: list[tuple[str | None, bytes]], window: int, schema: list[str]) -> Callable:
    """Follows the texts of a batch through one block's automaton and joins the findings to those of earlier blocks."""
    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = build(block, window)
        for batch in batches:
            n_words, spans, items, longest = [], [], [], []
            for text, old_spans, old_items, old_longest in zip(
                batch.column("__text").cast(pa.binary()).to_pylist(), *[batch.column(c).to_pylist() for c in ("__spans", "__items", "__longest")],
                strict=True,
            ):
                text = words(text)
                marked, names, best = automaton.trace(text)
                if old_spans:
                    marked = joined(marked, [[s["first"], s["first"] + s["words"]] for s in old_spans])
                n_words.append(len(text))
                spans.append([{"first": first, "words": end - first} for first, end in marked])
                items.append(sorted(names.union(old_items)) if names or old_items else [])
                longest.append(max(best, old_longest))
            found = {
                "__words": pa.array(n_words, pa.int64()),
                "__spans": pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))),
                "__items": pa.array(items, pa.list_(pa.string())), "__longest": pa.array(longest, pa.int64()),
            }
            yield pa.RecordBatch.from_arrays([found[c] if c in found else batch.column(c) for c in schema], names=schema)

    return follow


def _followed(rows: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, window: int, block_words: int,
              keep_text: bool) -> DataFrame:
    """``rows`` (with ``__text``) and the findings ``__words``, ``__spans``, ``__items``, ``__longest``."""
    pieces = stage(item_pieces(benchmark, item_col, item_text_col, window, max(PIECE_WORDS, 2 * window)), "items")
    blocks = max(1, -(-(pieces.agg(F.sum("n")).first()[0] or 0) // block_words))
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("item", "piece"), F.lit(blocks)))
    rows = rows.withColumns({"__words": F.lit(0).cast("long"), "__spans": F.array().cast(FOUND), "__items": F.array().cast("array<string>"),
                             "__longest": F.lit(0).cast("long")})
    for number in range(blocks):
        # Bounded by block_words, up to the chance of the hash.
        block = [(r.item, r.text.encode()) for r in dealt.where(F.col("block") == number).select("item", "text").collect()]
        keep = [f for f in rows.schema.fields if keep_text or number < blocks - 1 or f.name != "__text"]
        rows = rows.mapInArrow(_step(block, window, [f.name for f in keep]), StructType(keep))
        if number % RESIDENT == RESIDENT - 1 and number < blocks - 1:
            rows = stage(rows, "followed")
    return rows


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
         item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """What every document shares with the items: one row per document row.

    Returns ``doc_id``, ``n_words``, ``n_hit`` (words inside an occurrence of a window), ``spans`` (maximal runs of such
    words: number of the first word from 0, and length), ``longest`` (words of the longest run that some item holds,
    windows or not) and ``items`` (distinct ids, as strings, of the items with a window that occurs; ascending).

    * a null or empty text has no words; neither has one of ASCII punctuation only
    * items without words mark nothing; an item of fewer than ``window`` words marks where it occurs whole
    * rows that repeat an item id are one item with all their windows; an item without id marks words but is not listed
    * rows that repeat a document come out each; a null id stays null; no items: nothing is marked
    * texts and items may be of any length; other columns, whatever their names, are not read
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    found = _followed(rows, benchmark, item_col, item_text_col, window, block_words, keep_text=False)
    n_hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda total, span: total + span["words"])
    return found.select("doc_id", F.col("__words").alias("n_words"), n_hit.alias("n_hit"), F.col("__spans").alias("spans"),
                        F.col("__longest").alias("longest"), F.col("__items").alias("items"))


def without_spans(text: bytes, spans: list[dict]) -> bytes:
    """The text without the given runs of words and the separators behind them."""
    places = [m.span() for m in WORD.finditer(text.translate(WORD_BYTES))]
    out, at = [], 0
    for span in spans:
        end = span["first"] + span["words"]
        out.append(text[at:places[span["first"]][0]])
        at = places[end][0] if end < len(places) else len(text)
    return b"".join([*out, text[at:]])


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                   item_text_col: str = "text", window: int = WINDOW, min_span: int = WINDOW, max_coverage: float = 0.5,
                   block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents with all their columns, without marked spans of ``min_span`` words or more.

    A document of whose words more than ``max_coverage`` are marked goes as a whole. Texts without such spans, null and
    empty ones included, stay as they are.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    found = _followed(rows, benchmark, item_col, item_text_col, window, block_words, keep_text=True)
    hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda total, span: total + span["words"])
    long_spans = F.filter("__spans", lambda span: span["words"] >= min_span)
    kept = found.where(hit <= F.lit(max_coverage) * F.col("__words")).select("__row", "__text", long_spans.alias("__spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [without_spans(text, spans).decode() if spans else text
                     for text, spans in zip(batch.column("__text").cast(pa.binary()).to_pylist(), batch.column("__spans").to_pylist(), strict=True)]
            texts = [text.decode() if isinstance(text, bytes) else text for text in texts]
            yield pa.RecordBatch.from_arrays([batch.column("__row"), pa.array(texts, pa.string())], names=["__row", "__text"])

    out = kept.mapInArrow(cut, StructType([kept.schema["__row"], kept.schema["__text"]]))
    return out.select(*[F.col("__text").alias(c) if c == text_col else F.col("__row")[c].alias(c) for c in docs.columns])
