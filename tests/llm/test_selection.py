"""Mixing, packing, outliers and toxicity against brute force and held-out rows."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest

from tests.llm.test_dedup import SCHEMA, TEXTS, invented, table
from tracemill.llm import mixing, outliers, packing, toxicity
from tracemill.llm.common import prepare


def corpus(spark, n=600, seed=1):
    prepare(spark)
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = None if i % 41 == 0 else "big" if i % 3 == 0 else f"s{i % 7}"
        text = None if i % 97 == 0 else "" if i % 89 == 0 else invented(i, rng.choice([3, 40, 120, 700]))
        rows.append((i, text, "en", source, 0))
    return spark.createDataFrame(rows, SCHEMA), rows


def targets_by_hand(sizes):
    """Share by weight; cut at three times the size; share the rest again until nothing is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        target |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over
    return target


def test_mix_targets_and_sizes(spark):
    docs, rows = corpus(spark)
    got = mixing.mix(docs).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(rows)))
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows}
    source = {i: s for i, _, _, s, _ in rows}
    sizes = {}
    for i in size:
        sizes[source[i]] = sizes.get(source[i], 0) + size[i]
    want, taken = targets_by_hand(sizes), dict.fromkeys(sizes, 0)
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(want[source[r.doc_id]])
        assert r.taken == r.copies * r.size <= 3 * r.size
        certain = int(want[source[r.doc_id]] / sizes[source[r.doc_id]] + 1e-9)
        assert certain <= r.copies <= certain + 1
        taken[source[r.doc_id]] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(3, 0.01 * want[s])
    again = {r.doc_id: r.copies for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.copies for r in got}
    mixed = mixing.mixed(docs)
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert mixed.columns == docs.columns and counts == {i: c for i, c in again.items() if c}


def test_mix_caps_small_sources(spark):
    prepare(spark)
    rows = [(i, "w " * 100, "en", "a" if i else "tiny", 0) for i in range(40)]
    got = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0].target == 300 and got[0].copies == 3
    assert sum(r.taken for r in got.values()) == 4000


def by_tokenizers(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    model.encode_special_tokens = True
    return [model.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


HARD = ["<|endoftext|> it's  two\n\n lines\t", "naïve größe 12345 日本語 😀", "x" * 3000, " lead", "a b c", "'s 'll I've\r\n"]


def test_ids_equal_those_of_tokenizers():
    encode = packing.token_ids(packing.vocabulary_path())
    end = "<|endoftext|>"
    added = [end, f"{end}{end}", f"in{end}side", f"{end} at both ends {end}", f" {end} \n", end[:-1], f"<{end}>", f"twice {end}{end}, {end.upper()}"]
    for text, want in zip([*HARD, *added], by_tokenizers([*HARD, *added]), strict=True):
        assert [*encode(text), 2] == want


def test_pack_by_hand(spark):
    texts = [*TEXTS, *HARD, *[invented(i, 20 * (i % 60)) for i in range(150)]]
    docs = table(spark, texts)
    docs = docs.unionAll(docs.where("doc_id = 3")).repartition(5)
    got = packing.pack(docs).collect()
    want = []
    for i, ids in enumerate(by_tokenizers(texts)):
        first = (len(ids) - 1) % 1024 + 1
        starts = [0, *range(first, len(ids), 1024)]
        for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            want.append((i, piece, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted([*want, *[w for w in want if w[0] == 3]])
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for slots in sequences.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in got)
    assert len(sequences) <= -(-total // 1024) + 1


@pytest.mark.parametrize("seed", range(6))
def test_plans_are_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(np.maximum(rng.lognormal(5, 1, 3000).astype(int), 1), 1024)
    values, counts = np.unique(lengths, return_counts=True)
    plan = packing.plan(dict(zip(values.tolist(), counts.tolist(), strict=True)))
    used = {}
    for members, times in plan:
        assert sum(members) <= 1024 and times > 0
        for m in members:
            used[m] = used.get(m, 0) + times
    assert used == dict(zip(values.tolist(), counts.tolist(), strict=True))
    assert sum(t for _, t in plan) <= -(-int(lengths.sum()) // 1024) + 1


def test_complements_are_exact():
    counts = np.zeros(1025, dtype=np.int64)
    counts[[300, 200, 100, 50]] = [1, 2, 1, 5]
    index = packing.Complements(counts)
    assert index.single(200) == (200,) and index.single(201) is None
    assert index.pair(400) in ((300, 100), (200, 200)) and index.pair(600) is None
    assert index.triple(150) == (50, 50, 50) and index.triple(450) == (300, 100, 50)
    index.held = [300]
    assert index.pair(400) == (200, 200) and index.triple(450) == (200, 200, 50)


def statistics_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    dup = sum(1 for i, x in enumerate(lines) if x in lines[:i])
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), len(lines))


@pytest.mark.parametrize("text", [None, "", " \n", "a b c", "a b c a b c", "a\na\n \nb # c|c\nb # c|c", "x x x x x", "é <b> é <b> é",
                                  "a b\x0bc d a b c", invented(3, 200, "ab")])
def test_word_statistics(text):
    assert outliers.word_statistics(text) == statistics_by_hand(text)


def test_outliers_by_group(spark):
    prepare(spark)
    rng = random.Random(2)
    rows = []
    for i in range(400):
        words = invented(i, rng.randint(60, 300)).split()
        junk = i % 10 == 7
        if junk:
            words = [w + rng.choice(["***", " |", "$$"]) for w in words]
        lang = rng.choice(["en", None])
        rows.append((i, " ".join(words), lang, "a", int(junk)))
    rows += [(400, None, "en", "a", 0), (401, "few words", "en", "a", 0), (402, "again and again " * 40, "en", "a", 0),
             (403, invented(5000, 100), "new", "only", 0), (404, invented(5001, 100).replace(" ", "##$ "), "new", "only", 0)]
    got = {r.doc_id: r for r in outliers.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, text, *_ , junk in rows[:400]:
        assert got[i].kept is not bool(junk), (i, got[i])
        assert not got[i].base_failed
    assert [got[i].base_failed for i in range(400, 405)] == [True, True, True, False, False]
    assert [got[i].kept for i in range(400, 405)] == [False, False, False, True, False]


BAD = ["vile", "grotscum", "uglish"]


def labelled(spark, n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = invented(seed * 100_000 + i, rng.randint(20, 80)).split()
        toxic = rng.random() < 0.25
        for _ in range(rng.randint(2, 9) if toxic else 0):
            bad = rng.choice(BAD)
            words.insert(rng.randrange(len(words)), bad if rng.random() < 0.6 else bad + rng.choice("xyz") + rng.choice("pqr"))
        rows.append((i, " ".join(words).capitalize(), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    prepare(spark)
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), labels


def test_toxicity_held_out(spark):
    docs, labels, _ = labelled(spark, 900, 1)
    model = toxicity.fit(docs, labels)
    assert np.all(np.diff(model.thresholds) > 0) and len(model.thresholds) >= 2
    other, _, truth = labelled(spark, 400, 2)
    got = {r.doc_id: r for r in toxicity.score(other, model).collect()}
    wrong = sum(got[i].toxic != bool(t) for i, _, t in truth)
    assert wrong <= 4
    assert all(0 <= r.expected_severity <= len(model.thresholds) for r in got.values())
    mild, severe = "vile vilexp", "vile grotscum uglish vilexp uglishyq grotscumzr"
    assert model.margin(severe) > model.margin(mild) > model.margin("none of it")
    assert {r.doc_id for r in toxicity.without_toxic(other, model).collect()} == {i for i, r in got.items() if not r.toxic}


def test_toxicity_without_labels(spark):
    docs, labels, _ = labelled(spark, 30, 3)
    for odd in (labels.limit(0), labels.where("toxic = 0")):
        model = toxicity.fit(docs, odd)
        assert toxicity.score(docs, model).where("toxic").count() == 0


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(0)
    rows, grades = [], []
    for _ in range(600):
        grade = int(rng.integers(0, 4))
        rows.append(sorted(rng.choice(4, size=grade, replace=False).tolist()) + [4] * int(rng.random() < 0.5))
        grades.append(grade)
    weights, cuts = toxicity.fit_ordinal(rows, np.array(grades), 5)
    assert np.all(weights[:4] > 1) and abs(weights[4]) < 0.3 and np.all(np.diff(cuts) > 0)
    margin = np.array([weights[r].sum() for r in rows])
    assert np.mean(np.searchsorted(cuts, margin) == np.array(grades)) > 0.95


def test_repeating_outliers_below_the_base_rule(spark):
    """Repeated lines alone, and repeated phrases alone, reject a document that the base rule passes."""
    prepare(spark)
    lines = lambda seed, n, size: [invented(seed * 1000 + k, size) for k in range(n)]
    rows = [(i, "\n".join(lines(i, 20, 8)), "en", "a", 0) for i in range(300)]
    short = lines(900, 60, 2)
    rows.append((300, "\n".join(x for k in range(60) for x in ([short[k], short[k // 2]] if k % 2 else [short[k]])), "en", "a", 0))
    phrases = lines(901, 6, 5)
    text = " ".join(f"{phrases[k % 6]} {invented(902_000 + k, 10)}" for k in range(12))
    rows.append((301, text, "en", "a", 0))
    got = {r.doc_id: r for r in outliers.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i].kept for i in range(300))
    assert not got[300].base_failed and got[300].n_dup_lines == 30 and not got[300].kept
    assert not got[301].base_failed and got[301].n_dup_lines == 0 and not got[301].kept


def test_mixed_keeps_rows_without_id(spark):
    rows = [(None if i % 3 == 0 else i, invented(i, 20 + i % 50), "en", f"s{i % 3 if i % 2 else 4}", 0) for i in range(300)]
    prepare(spark)
    docs = spark.createDataFrame(rows, SCHEMA)
    plan, got = mixing.mix(docs).collect(), mixing.mixed(docs).collect()
    assert sum(r.copies for r in plan if r.doc_id is None) == sum(r.doc_id is None for r in got) > 0
    assert sum(r.copies for r in plan) == len(got) and sum(r.taken for r in plan) == sum(len(r.text.split()) for r in got)


def exact_mcd(x):
    """Squared distances under the exact estimate: of all halves the one with the smallest determinant."""
    d, half = x.shape[1], (len(x) + x.shape[1] + 1) // 2
    floors = np.diag(np.square(outliers.FLOORS))
    halves = (x[list(chosen)] for chosen in itertools.combinations(range(len(x)), half))
    best = min(halves, key=lambda h: np.linalg.det(np.cov(h.T, bias=True) + floors))
    off = x - best.mean(axis=0)
    distance = np.einsum("ni,ij,nj->n", off, np.linalg.inv(np.cov(best.T, bias=True) + floors), off)
    return distance, best.mean(axis=0), d


def test_estimates_against_exact_mcd(spark):
    """On small groups with planted outliers: the centre and the documents beyond the limit are those of the exact estimate."""
    prepare(spark)
    rng = np.random.default_rng(5)
    rows, groups = [], {}
    for group in range(6):
        x = rng.normal(0, 0.15, (14, 4)) + rng.normal(0, 1, 4)
        x[:3] += rng.choice([-4.0, 4.0], (3, 4))
        groups[f"g{group}"] = x
        rows += [(f"g{group}", *map(float, row)) for row in x]
    table_ = spark.createDataFrame(rows, "grp string, x0 double, x1 double, x2 double, x3 double")
    for row in outliers.mcd(table_).collect():
        x = groups[row.grp]
        exact, centre, d = exact_mcd(x)
        off = x - np.array(row.centre)
        distance = np.einsum("ni,ij,nj->n", off, np.array(row.inverse).reshape(d, d), off) / row.scale
        assert set(np.flatnonzero(distance > outliers.CHI2_LIMIT)) == {0, 1, 2}
        assert set(np.argsort(exact)[-3:]) == {0, 1, 2} and exact[:3].min() > outliers.CHI2_LIMIT
        assert np.abs(np.array(row.centre) - centre).max() < 0.15


def test_estimates_are_drawn_towards_the_language():
    """The weight of the group around falls evenly with the size: there is no size at which the estimate jumps."""
    import pandas as pd

    wide, narrow = np.diag([1.0] * 4), np.diag([25.0] * 4)
    sizes = list(range(1, 400))
    rows = pd.DataFrame([("g", n, [1.0] * 4, narrow.ravel().tolist(), 2.0, [0.0] * 4, wide.ravel().tolist(), 1.0) for n in sizes],
                        columns=["grp", "size", "centre", "inverse", "scale", "up_centre", "up_inverse", "up_scale"])
    got = outliers._mixture(rows, 50)
    centres = np.array([c[0] for c in got["centre"]])
    assert np.allclose(centres, [n**2 / (n**2 + 2500) for n in sizes]) and np.all(np.diff(got["scale"]) > 0)
    assert np.abs(np.diff([m[0] for m in got["inverse"]])).max() < 0.1
    spread = np.linalg.inv(np.array(got["inverse"][49]).reshape(4, 4)) - np.diag(np.square(outliers.FLOORS))
    own, above = np.linalg.inv(narrow) - np.diag(np.square(outliers.FLOORS)), np.eye(4) - np.diag(np.square(outliers.FLOORS))
    assert np.allclose(spread, own / 2 + above / 2 + 0.25)
