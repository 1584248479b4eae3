"""Exact, near and substring deduplication against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from tracemill.llm import exact_dedup, simhash, substring_dedup
from tracemill.llm.common import prepare
from tracemill.llm.components import components

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def table(spark, texts, start=0):
    prepare(spark)
    return spark.createDataFrame([(start + i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def invented(seed, words, letters="abcdefghij"):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 8))) for _ in range(words))


TEXTS = [None, "", " \t\n", "a b c", "ab c", "a\x0bbc ", "abd", invented(1, 300), invented(1, 300) + " ", invented(2, 300), "é a", "éa",
         "x y", "xy", "a" * 70 + "b", "a" * 70 + "c", "long " * 5000, "long" * 5000]


def exact_by_hand(rows):
    groups = {}
    for i, text in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups.setdefault(norm, []).append((-len(text or ""), i))
    out = {}
    for norm, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            out[i] = (keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest())
    return out


@pytest.mark.parametrize("digest_all", [True, False])
def test_exact_groups(spark, digest_all):
    docs = table(spark, TEXTS)
    want = exact_by_hand(list(enumerate(TEXTS)))
    got = {r.doc_id: r for r in exact_dedup.refine(docs, digest_all=digest_all).collect()}
    assert len(got) == len(TEXTS)
    for i, (keep, size, kept, digest) in want.items():
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (keep, size, kept)
        assert got[i].text_sha256 == digest or (not digest_all and size == 1 and got[i].text_sha256 is None)
    kept = exact_dedup.without_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, row in want.items() if row[2])


def test_exact_repeated_ids(spark):
    docs = table(spark, ["one two", "one two", "other"]).withColumnRenamed("n_chars", "size")
    rows = docs.unionAll(docs.where("doc_id = 1"))
    got = exact_dedup.refine(rows).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == [
        (0, 0, 3, True), (1, 0, 3, False), (1, 0, 3, False), (2, 2, 1, True)]


def print_by_hand(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(prints):
    """prints: list of (id, fingerprint)"""
    parent = list(range(len(prints)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(prints):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return {doc: least[find(i)] for i, (doc, _) in enumerate(prints)}


@pytest.mark.parametrize("text", ["", None, "Ä É", "ONE two", "A b C d", "a b c", invented(5, 40).upper()])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == print_by_hand(text)


def test_near_duplicates(spark):
    rng = random.Random(3)
    base = invented(7, 400).split()
    texts = list(TEXTS)
    for _ in range(60):  # near copies of one text: chains of links
        words = list(base)
        for _ in range(rng.randint(1, 3)):
            words[rng.randrange(len(words))] = "new" + str(rng.random())
        texts.append(" ".join(words))
    docs = table(spark, texts)
    prints = [(i, print_by_hand(t)) for i, t in enumerate(texts)]
    want = components_by_hand(prints)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(got[i].fingerprint == f"{p:016x}" for i, p in prints)
    assert len(set(want.values())) < len(texts) - 20
    kept = simhash.one_per_component(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_hot_anchor_is_split(spark):
    """Many fingerprints at one anchor, compared in chunks, give the same links."""
    prepare(spark)
    rng = np.random.default_rng(4)
    prints = np.unique(np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, (400, 4)).astype(np.uint64), axis=1))
    frame = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp bigint")
    want = components_by_hand([(int(x), int(np.int64(x).view(np.uint64))) for x in prints.view(np.int64)])
    for limit in (5, 4096):
        member = {r.node: r.root for r in components(simhash.links(frame, home_limit=limit)).collect()}
        assert {x: member.get(x, x) for x in want} == want


def test_every_pair_meets():
    """Random pairs at most three bits apart share an anchor: one at home, the other visiting."""
    rng = np.random.default_rng(5)
    one = rng.integers(0, 2**64, 800, dtype=np.uint64)
    other = one.copy()
    for _ in range(3):
        other ^= np.uint64(1) << rng.integers(0, 64, len(one)).astype(np.uint64)
    for codes in (simhash.BLOCKS, (simhash.GOLAY, simhash.HAMMING_15)):
        home_a, who_a, where_a = simhash.visits(one, codes)
        home_b, who_b, where_b = simhash.visits(other, codes)
        reach_a, reach_b = set(zip(who_a.tolist(), where_a.tolist())), set(zip(who_b.tolist(), where_b.tolist()))
        for i in range(len(one)):
            a, b = int(home_a[i]), int(home_b[i])
            assert a == b or (i, b) in reach_a or (i, a) in reach_b


def test_components_of_chains(spark):
    prepare(spark)
    chain = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 95: 90, 100: 90}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_gear_hash_is_rolling():
    data = np.frombuffer(invented(9, 50).encode(), dtype=np.uint8)
    rolled, value = [], 0
    for byte in data:
        value = (2 * value + int(substring_dedup.GEAR[byte])) & 0xFFFF
        rolled.append(value)
    assert substring_dedup.gear_hashes(data).tolist() == rolled


def test_cuts_resist_insertions():
    raw = (invented(11, 2000) + " größe Ünïcode ").encode()
    ends = substring_dedup.cuts(np.frombuffer(raw, dtype=np.uint8)).tolist()
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(raw) and sizes.max() <= substring_dedup.MAX_CHUNK + 3
    changed = raw[:5000] + b"inserted" + raw[5000:]
    moved = substring_dedup.cuts(np.frombuffer(changed, dtype=np.uint8)).tolist()
    assert len({e for e in ends if e > 5100} ^ {e - 8 for e in moved if e > 5108}) == 0
    for cut in ends:
        raw[:cut].decode()


def spans_by_hand(texts, words):
    """(doc, first word, last word + 1) of the maximal parts whose windows of some words another document holds."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    held = {}
    for i, w in enumerate(split):
        for k in range(len(w) - words + 1):
            held.setdefault(tuple(w[k:k + words]), set()).add(i)
    found = []
    for i, w in enumerate(split):
        at = [k for k in range(len(w) - words + 1) if len(held[tuple(w[k:k + words])]) > 1]
        for k in at:
            if found and found[-1][0] == i and k <= found[-1][2]:
                found[-1][2] = k + words
            else:
                found.append([i, k, k + words])
    return found


def test_repeated_passages(spark):
    """Passages of over 50 words are found with their extent; shorter ones, and texts of their own, are left alone."""
    texts = [None, "", *[invented(200 + i, 60) for i in range(20)]]
    for i in range(40):
        p = invented(100 + i, 52 + i)
        texts.append(f"{invented(300 + i, 30)} {p} {invented(400 + i, 25)}")
        texts.append(f"{invented(500 + i, 40)}\n" + p.replace(" ", " \n" if i % 2 else "  "))
    line = invented(77, 40)
    texts += [f"{invented(600 + i, 50)} {line}" for i in range(10)]
    want = spans_by_hand(texts, 48)
    assert {i for i, *_ in want} == set(range(22, 102))
    docs = table(spark, texts)
    found = {}
    for row in substring_dedup.repeated_spans(docs).collect():
        found.setdefault(row.doc_id, []).append(row)
    assert set(found) == {i for i, *_ in want}
    for i, first, last in want:
        places = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", texts[i].encode())]
        inside = [k for k, (a, b) in enumerate(places) for r in found[i] if a < r.stop and b > r.start]
        # A long run of whole chunks may end a chunk early or in the middle of a word.
        assert first - 1 <= min(inside) and max(inside) <= last and len(set(inside)) >= 48
        owner = i - i % 2
        assert all(r.is_first == (i == owner) and r.first_doc_id == owner for r in found[i])
    rest = {r.doc_id: r.text for r in substring_dedup.remove_repeats(docs).collect()}
    for i, text in enumerate(texts):
        if i in found and i % 2:
            assert len(rest[i].split()) <= 40 + 50 and rest[i].startswith(text[:100])
        else:
            assert rest[i] == text


def test_repeats_inside_one_document_do_not_count(spark):
    line = invented(900, 60)
    docs = table(spark, [f"{line}\n{line}", invented(901, 60)])
    assert substring_dedup.repeated_spans(docs).count() == 0


@pytest.mark.parametrize("n_p, n_q", [(120, 120), (52, 90), (90, 52), (5, 80)])
def test_each_part_of_nested_repeats_stays_once(spark, n_p, n_q):
    """Copies that share a part with an earlier document keep what only they hold, once."""
    p, q = invented(910, n_p), invented(911, n_q)
    docs = table(spark, [f"{invented(912, 70)} {p}" if n_p < 48 else p, f"{p} {q}", f"{p} {q}", invented(913, 90)])
    rest = [r.text for r in substring_dedup.remove_repeats(docs).orderBy("doc_id").collect()]
    assert rest[0].endswith(p) and len(rest[3].split()) == 90
    assert rest[1].endswith(q[20:]) and sum(q[60:-60] in text for text in rest) == 1
    assert sum(p[40:-40] in text for text in rest) == 1 or n_p < 48
    assert len(rest[2].split()) <= 12


def test_passages_nested_in_two_groups_stay_once(spark):
    """Two groups of copies share a passage too short for whole chunks of its own with 48 words."""
    p = invented(920, 54)
    a, b = (f"{invented(921 + i, 80)} {p} {invented(931 + i, 80)}" for i in range(2))
    docs = table(spark, [a, b, a, b])
    rest = [r.text for r in substring_dedup.remove_repeats(docs).orderBy("doc_id").collect()]
    assert rest[0] == a and rest[1].startswith(invented(922, 80)[:-1]) and rest[1].endswith(invented(932, 80)[1:])
    assert p[5:-5] not in rest[1] and len((rest[2] + rest[3]).split()) <= 12


def test_chunks_of_many_documents_are_no_passage(spark):
    """A text of chunks that different documents hold each is no repeated passage."""
    words = invented(940, 400).encode()
    ends = [0, *substring_dedup.cuts(np.frombuffer(words, dtype=np.uint8)).tolist()]
    texts = [words.decode()]
    for i in range(len(ends) - 3):
        held = words[max(ends[i] - 30, 0):ends[i + 1] + 1].decode()
        texts.append(f"{invented(1000 + i, 60)} {held} {invented(2000 + i, 60)}")
    docs = table(spark, texts)
    chunks = substring_dedup.chunks(docs)
    shared = chunks.where("doc_id = 0").join(chunks.where("doc_id > 0").select("digest").distinct(), "digest", "left_semi")
    assert shared.agg({"words": "sum"}).first()[0] > 100
    assert substring_dedup.repeated_spans(docs).count() == 0


def test_one_row_of_repeated_ids_stays(spark):
    """A retried write: rows that share id and text leave one row behind in both stages, null ids too."""
    rows = [(1, invented(70, 60), "en", "s", 1)] * 5 + [(1, invented(71, 60), "en", "s", 1), (2, invented(70, 60), "en", "s", 1)]
    rows += [(None, invented(72, 60), "en", "s", 1)] * 3 + [(3, invented(73, 60), "en", "s", 1), (3, invented(73, 60) + " ", "en", "s", 2)]
    prepare(spark)
    docs = spark.createDataFrame(rows, SCHEMA)
    for digest_all in (True, False):
        kept = [(r.doc_id, r.group_size) for r in exact_dedup.refine(docs, digest_all=digest_all).collect() if r.kept]
        assert sorted(kept, key=str) == sorted([(1, 6), (1, 1), (None, 3), (3, 2)], key=str)
    unique = [(r.doc_id, r.text) for r in exact_dedup.without_copies(docs).collect()]
    assert sorted(unique, key=str) == sorted([(1, invented(70, 60)), (1, invented(71, 60)), (None, invented(72, 60)), (3, invented(73, 60) + " ")], key=str)
    single = simhash.one_per_component(docs)
    assert sorted((str(r.doc_id) for r in single.collect())) == ["1", "1", "3", "None"] and single.columns == docs.columns
