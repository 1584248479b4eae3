"""Suffix automaton and decontamination against plain search."""

import random
import re

import pytest

from tests.llm.test_dedup import SCHEMA, table
from tracemill.llm import decontamination
from tracemill.llm.common import prepare

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return PATTERN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_hand(text, items, window=10):
    """(n_words, marked word numbers, item ids) by comparing every window of every item with every place."""
    words, marked, names = split(text), set(), set()
    for name, item in items:
        item = split(item)
        size = min(window, len(item))
        windows = {tuple(item[i:i + size]) for i in range(len(item) - size + 1)} if item else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i:i + size]) in windows:
                marked |= set(range(i, i + size))
                if name is not None:
                    names.add(str(name))
    return len(words), marked, sorted(names)


def items_table(spark, items):
    prepare(spark)
    return spark.createDataFrame(items, "item_id bigint, text string")


def check(spark, texts, items, **options):
    got = decontamination.scan(table(spark, texts), items_table(spark, items), **options).collect()
    assert len(got) == len(texts)
    for row in got:
        n, marked, names = by_hand(texts[row.doc_id], items, options.get("window", 10))
        assert (row.n_words, row.n_hit, row["items"]) == (n, len(marked), names)
        assert {i for s in row.spans for i in range(s.first, s.first + s.words)} == marked


def texts_and_items(seed, vocabulary, count=60):
    rng = random.Random(seed)
    run = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [run(rng.randint(0, 30)) for _ in range(25)]
    texts = []
    for _ in range(count):
        text = run(rng.randint(0, 50))
        for _ in range(rng.randint(0, 3)):
            item = rng.choice(items)
            first = rng.randint(0, len(item))
            text += item[first:first + rng.randint(0, 20)] + run(rng.randint(0, 5))
        texts.append(" ".join(text))
    return texts, [(i, " ".join(item)) for i, item in enumerate(items)]


@pytest.mark.parametrize("seed,letters", [(1, "ab"), (2, "abcdef"), (3, "abcdefghijklmnopqrstuvwxyz")])
def test_scan_against_plain_search(spark, seed, letters):
    texts, items = texts_and_items(seed, list(letters))
    check(spark, texts, items)
    check(spark, texts, items, window=4)


def test_many_blocks_find_the_same(spark):
    texts, items = texts_and_items(4, [f"w{i}" for i in range(12)])
    check(spark, texts, items, block_words=40)


def test_words_and_odd_items(spark):
    items = [(1, "One TWO three, four-five six seven eight nine ten eleven"), (2, "É über x"), (3, None), (4, " ,.;"), (5, "short item"),
             (5, "and one more of five"), (None, "nobody knows this"), (7, "item")]
    texts = ["zero one two three four five six seven eight nine ten", "ONE-TWO three/four five; six seven eight nine ten eleven!", "é über x",
             "É über x y", None, "", "...", "a short item and one more of five", "nobody knows this item", "short  Item",
             "one two three four five six seven eight nine", "w " * 30_000 + "short item"]
    check(spark, texts, items)


def test_long_items_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "PIECE_WORDS", 20)
    rng = random.Random(5)
    item = [f"w{rng.randint(0, 500)}" for _ in range(300)]
    texts = [" ".join(item[i:i + 12]) for i in range(0, 290, 7)]
    check(spark, texts, [(1, " ".join(item))], block_words=50)


def test_longest_match_counts_without_a_window(spark):
    got = decontamination.scan(table(spark, ["x b c d y", "c d e f g h i j k l m n", "z"]),
                               items_table(spark, [(1, "a b c d e f g h i j k l m")])).orderBy("doc_id").collect()
    assert [(r.longest, r.n_hit) for r in got] == [(3, 0), (11, 11), (0, 0)]


def test_spans_are_removed_and_covered_documents_go(spark):
    item = "a b c d e f g h i j k"
    docs = table(spark, [f"Before, {item.upper()}! After this there are enough other words to stay here", item + " x", None, "clean. Text",
                         f"é {item} " + "ü " * 30 + item])
    out = decontamination.decontaminated(docs, items_table(spark, [(1, item)]))
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {
        0: "Before, After this there are enough other words to stay here", 2: None, 3: "clean. Text", 4: "é " + "ü " * 30}
    wide = docs.selectExpr("*", "1 AS __row", "2 AS spans", "3 AS __words")
    assert decontamination.decontaminated(wide, items_table(spark, [(1, item)])).columns == wide.columns
    assert {r.doc_id for r in decontamination.decontaminated(docs, items_table(spark, [(1, item)]), max_coverage=1.0, min_span=99).collect()} == {0, 1, 2, 3, 4}


def test_empty_tables(spark):
    prepare(spark)
    none, items = spark.createDataFrame([], SCHEMA), items_table(spark, [(1, "a")])
    assert decontamination.scan(none, items).count() == 0
    docs = table(spark, ["a b", None]).selectExpr("*", "1 AS items", "2 AS __text", "3 AS n_hit")
    got = decontamination.scan(docs, items.limit(0)).collect()
    assert [(r.n_words, r.n_hit, r["items"]) for r in sorted(got, key=lambda r: r.doc_id)] == [(2, 0, []), (0, 0, [])]
