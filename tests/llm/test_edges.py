"""Every operator and stage over empty tables, null columns, repeated rows and extra columns with clashing names."""

import pytest

import corpus_pipeline
from tests.llm.test_dedup import SCHEMA, invented
from tests.llm.test_selection import labelled
from tracemill.llm import exact_dedup, html_text, mixing, outliers, packing, simhash, substring_dedup, surrogates, toxicity, warc_fixity
from tracemill.llm.common import prepare

MODEL = toxicity.Model({"bad": 0}, __import__("numpy").array([5.0]), __import__("numpy").array([2.0, 4.0]))
BY_DOCUMENT = {
    "simhash": simhash.near_duplicates, "exact": lambda d: exact_dedup.refine(d, digest_all=True), "refine": exact_dedup.refine,
    "mixing": mixing.mix, "outliers": outliers.judge, "toxicity": lambda d: toxicity.score(d, MODEL),
    "surrogates": lambda d: surrogates.pseudonymise(d, b"key"),
}
OTHERS = {
    "packing": packing.pack, "spans": substring_dedup.repeated_spans, "removed": substring_dedup.remove_repeats,
    "mixed": mixing.mixed, "one": simhash.one_per_component, "unique": exact_dedup.without_copies,
    "clean": lambda d: toxicity.without_toxic(d, MODEL),
}
#: Names that the operators use inside.
CLASHING = ["fp", "size", "key", "rank", "copies", "norm", "grp", "x0", "__chunk", "count", "digest", "root", "kept"]


def odd_rows(spark):
    prepare(spark)
    rows = [(None, None, None, None, None), (1, None, "en", None, 0), (2, "", None, "s", None), (3, "bad " * 30_000, "en", "s", 1),
            (4, "x" * 200_000, "en", "s", 1), (5, invented(1, 90), "en", "s", 1), (6, invented(1, 90), "en", "s", 1),
            (6, invented(1, 90), "en", "s", 1), (7, "é  ß 日本", "de", "t", 2)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("name", [*BY_DOCUMENT, *OTHERS])
def test_odd_documents(spark, name):
    operator = {**BY_DOCUMENT, **OTHERS}[name]
    docs = odd_rows(spark)
    got = operator(docs)
    rows = got.collect()
    if name in BY_DOCUMENT and name != "simhash":
        assert len(rows) == docs.count()
    assert operator(docs.limit(0)).count() == 0
    wide = docs
    for column in CLASHING:
        wide = wide.selectExpr("*", f"'clash' AS `{column}`")
    if name not in OTHERS or name in ("packing", "spans"):
        order = lambda r: str(r)
        # Pieces of equal length may swap places.
        last = 5 if name == "packing" else None
        assert sorted((tuple(r)[:last] for r in operator(wide).collect()), key=order) == sorted((tuple(r)[:last] for r in rows), key=order)
    else:
        assert operator(wide).columns == wide.columns
        assert operator(wide).count() == len(rows)


def test_odd_pages(spark):
    prepare(spark)
    pages = spark.createDataFrame([(None, None, None), (1, "u", "<p>a"), (1, "u", "<p>a")], "page_id bigint, url string, html string")
    wide = pages.selectExpr("*", "1 AS text", "2 AS n_chars", "3 AS record", "4 AS archive", "5 AS length")
    assert html_text.extract(wide).count() == 3 and html_text.extract(wide.limit(0)).count() == 0
    records = warc_fixity.placed(warc_fixity.warc_records(wide))
    assert records.count() == 3
    assert warc_fixity.audit(records, records).count() == 0
    gone = warc_fixity.audit(records, records.where("page_id is null"))
    assert {r.status for r in gone.collect()} == {"missing"}


def test_pipeline_over_odd_rows(spark, tmp_path):
    docs, labels, _ = labelled(spark, 200, 9)
    odd_rows(spark).unionAll(docs.selectExpr("doc_id + 100", "text", "lang", "source", "n_chars")).write.parquet(f"{tmp_path}/documents.parquet")
    labels.selectExpr("doc_id + 100 AS doc_id", "quality", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_rows_without_id_are_later_than_any(spark):
    prepare(spark)
    texts = {n: invented(n, 1500) for n in (1, 2, 3)}
    near = lambda text, n: f"{text} other{n}"
    rows = [(7, texts[1]), (None, texts[1]), (None, near(texts[1], 1)), (None, near(texts[1], 2)),
            (None, texts[2]), (None, near(texts[2], 2)), (None, texts[2] + " "), (9, texts[3]), (9, texts[3])]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    component = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert component == {(7, 7), (None, 7), (None, None), (9, 9)}
    left = simhash.one_per_component(docs).collect()
    assert sorted((r.doc_id or 0) for r in left) == [0, 7, 9]
    assert [r.text for r in left if r.doc_id is None][0] in (texts[2] + " ", near(texts[2], 2))


def test_surrogates_of_rows_without_id_stay_apart(spark):
    prepare(spark)
    docs = spark.createDataFrame([(None, f"password={n}", "en", "s", 0) for n in range(10)] * 2, SCHEMA)
    made = [r.text.removeprefix("password=") for r in surrogates.pseudonymise(docs, b"key").collect()]
    assert len(made) == 20 and len(set(made)) == 10 and not {str(n) for n in range(10)} & set(made)


def test_labelled_sample_is_bounded_by_rows(spark, monkeypatch):
    docs, labels, _ = labelled(spark, 200, 5)
    again = docs.union(docs.limit(1).crossJoin(spark.range(500)).drop("id"))
    sizes = []
    fit = toxicity.fit_ordinal
    monkeypatch.setattr(toxicity, "fit_ordinal", lambda rows, *a: (sizes.append(len(rows)), fit(rows, *a))[1])
    toxicity.fit(again, labels, fit_rows=50)
    assert sizes == [50]


def test_repeats_of_rows_that_share_an_id_or_have_none(spark):
    prepare(spark)
    shared = invented(77, 60)
    texts = ["\u00e9" * 30 + " " + shared, "\u0436" * 31 + " x " + shared + " y", "z " + shared]
    for ids in ((1, 1, 2), (None, None, None), (5, None, None)):
        docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in zip(ids, texts)], SCHEMA)
        rest = sorted(r.text for r in substring_dedup.remove_repeats(docs).collect())
        assert sum(shared in t for t in rest) == 1 and len(rest) == 3
        assert {r.doc_id for r in substring_dedup.repeated_spans(docs).collect()} <= set(ids)
    assert [r.text for r in substring_dedup.remove_repeats(spark.createDataFrame([(1, shared, "en", "s", 0)] * 2, SCHEMA)).collect()] == [shared] * 2
