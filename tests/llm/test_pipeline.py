"""The pipeline, stage by stage, against brute force on a small corpus."""

import random

import corpus_pipeline
from tests.llm.test_dedup import SCHEMA, components_by_hand, exact_by_hand, invented, print_by_hand
from tests.llm.test_selection import BAD, by_tokenizers, targets_by_hand
from tracemill.llm.common import prepare


def test_stages(spark, tmp_path):
    prepare(spark)
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(500):
        words = invented(10_000 + i, rng.randint(30, 300)).split()
        toxic = rng.random() < 0.2
        for _ in range(4 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words), "en", f"s{i % 5}", 0))
        if i % 2:
            labels.append((i, 1, int(toxic)))
    toxic_ids = {i for i, t, *_ in rows if any(b in t.split() for b in BAD)}
    for i in range(40):  # exact copies, and near copies of long texts
        rows.append((500 + i, rows[i][1].replace(" ", "  "), "en", "s1", 0))
        words = rows[100 + i][1].split()
        words[3] = "changed"
        rows.append((600 + i, " ".join(words), "en", "s2", 0))
    toxic_ids |= {i for i, t, *_ in rows if any(b in t.split() for b in BAD)}
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, step in corpus_pipeline.STAGES:
        step(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS

    clean = [r for r in rows if r[0] not in toxic_ids]
    assert {r.doc_id for r in kept["toxicity"]} == {r[0] for r in clean}
    judged = exact_by_hand([(i, t) for i, t, *_ in clean])
    unique = [r for r in clean if judged[r[0]][2]]
    assert {r.doc_id for r in kept["exact_dedup"]} == {r[0] for r in unique}
    first = components_by_hand([(i, print_by_hand(t)) for i, t, *_ in unique])
    single = [r for r in unique if first[r[0]] == r[0]]
    assert {r.doc_id for r in kept["near_dedup"]} == {r[0] for r in single} and len(single) < len(unique)

    sizes, taken, copies = {}, {}, {}
    for _, text, _, source, _ in single:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    for row in kept["mixing"]:
        taken[row.source] = taken.get(row.source, 0) + len(row.text.split())
        copies[row.doc_id] = copies.get(row.doc_id, 0) + 1
    for source, target in targets_by_hand(sizes).items():
        assert abs(taken[source] - target) <= 0.02 * target
    assert max(copies.values()) <= 3

    tokens = {i: len(ids) for (i, *_), ids in zip(single, by_tokenizers([t for _, t, *_ in single]), strict=True)}
    packed, open_ = {}, []
    for length in sorted((row.length for row in kept["packing"]), reverse=True):  # first fit, longest first
        place = next((i for i, left in enumerate(open_) if left >= length), None)
        if place is None:
            open_.append(1024 - length)
        else:
            open_[place] -= length
    for row in kept["packing"]:
        packed[row.doc_id] = packed.get(row.doc_id, 0) + row.length
    assert packed == {i: n * tokens[i] for i, n in copies.items()}
    used = len({r.sequence_id for r in kept["packing"]})
    assert used <= len(open_) * 1.02 + 1
    whole = corpus_pipeline.run(spark, str(tmp_path)).drop("sequence_id", "offset")
    assert sorted(map(tuple, whole.collect())) == sorted(tuple(r)[:5] for r in kept["packing"])
