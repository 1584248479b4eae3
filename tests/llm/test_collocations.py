"""Collocations against counting every phrase length on its own."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.test_dedup import SCHEMA
from tracemill.llm import collocations
from tracemill.llm.common import prepare


def by_hand(rows, max_words=5, min_count=100, top=2000, percent=100):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i:i + k])] += 1
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= min_count}
    covered = set()
    for (lang, phrase), a in candidates.items():
        for m in range(2, len(phrase)):
            for i in range(len(phrase) - m + 1):
                if 100 * a >= percent * f[lang, phrase[i:i + m]]:
                    covered.add((lang, phrase[i:i + m]))
    out = {}
    for (lang, phrase), a in candidates.items():
        if (lang, phrase) not in covered:
            cuts = [(1000 * a * n[lang] // (f[lang, phrase[:k]] * f[lang, phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(phrase).encode(), f[lang, phrase[:k]], f[lang, phrase[k:]]))
    return [(lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, rows_ in out.items()
            for rank, (s, a, p, l, r) in enumerate(sorted(rows_)[:top], 1)]


def table(spark, rows, schema=SCHEMA):
    prepare(spark)
    return spark.createDataFrame([(i, t, lang, "s", 0) for i, (t, lang) in enumerate(rows)], schema)


def random_rows(seed, count, words="a b c d e é ü New york City".split(), breaks=(" ", " ", " ", "  ", "\t", ", ", ".\n", "\x0b")):
    rng = random.Random(seed)
    return [("".join(rng.choice(words) + rng.choice(breaks) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None]))
            for _ in range(count)]


@pytest.mark.parametrize("seed,options", [(1, {"min_count": 5}), (2, {"min_count": 3, "max_words": 3, "top": 10}),
                                          (3, {"min_count": 2, "covered_percent": 60}), (4, {"min_count": 4, "bucket_bits": 15})])
def test_against_plain_counts(spark, seed, options):
    rows = random_rows(seed, 80) + [("new york city is here", "en")] * 9 + [(None, "en"), ("", None), (None, None), ("A" * 5000, "de")]
    got = collocations.collocations(table(spark, rows).repartition(7), **options).collect()
    named = {"percent": options.pop("covered_percent", 100)}
    options.pop("bucket_bits", None)
    assert sorted(map(tuple, got)) == sorted(by_hand(rows, **options, **named))
    assert got


def test_counts_of_all_phrases(spark):
    rows = [("x y z, x y", "en"), ("X Y\tz x", "en"), ("x y z x y", "fr")]
    got = {(r.lang, r.phrase): r.f for r in collocations.phrase_counts(table(spark, rows), min_count=1).collect()}
    assert got["en", ""] == 9 and got["en", "x y"] == 3 and got["en", "x y z x"] == 1 and got["en", "y z"] == 2 and got["en", "z x"] == 1
    assert ("en", "z x y") not in got and got["fr", "x y z x y"] == 1 and got["fr", "x"] == 2


def test_full_bitmap_changes_nothing(spark, monkeypatch):
    rows = random_rows(5, 60)
    want = sorted(map(tuple, collocations.collocations(table(spark, rows), min_count=6).collect()))
    monkeypatch.setattr(collocations, "frequent_runs",
                        lambda texts, size, known, n, bits: np.full((1 << bits) // 8, 255, dtype=np.uint8))
    assert sorted(map(tuple, collocations.collocations(table(spark, rows), min_count=6).collect())) == want


def test_products_beyond_64_bits(spark):
    frame = spark.sql("SELECT CAST(3000000000000 AS decimal(19,0)) a, CAST(9000000000000001 AS decimal(19,0)) n, "
                      "CAST(3000000000007 AS decimal(19,0)) l, CAST(5000000000003 AS decimal(19,0)) r")
    assert frame.selectExpr("(1000 * a * n) div (l * r) AS s").first().s == 1000 * 3000000000000 * 9000000000000001 // (3000000000007 * 5000000000003)


def test_empty_and_clashing(spark):
    prepare(spark)
    assert collocations.collocations(table(spark, [])).count() == 0
    assert collocations.collocations(table(spark, [(None, None), ("", "en"), ("one two", "en")])).count() == 0
    rows = random_rows(6, 40)
    wide = table(spark, rows).selectExpr("*", "1 AS w1", "2 AS n", "3 AS f", "'x' AS phrase", "4 AS size", "5 AS rolled")
    assert sorted(map(tuple, collocations.collocations(wide, min_count=5).collect())) == sorted(by_hand(rows, min_count=5))
