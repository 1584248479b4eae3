"""One query per operator, over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import (
    collocations,
    decontamination,
    exact_dedup,
    html_text,
    mixing,
    outliers,
    packing,
    simhash,
    substring_dedup,
    surrogates,
    toxicity,
    warc_fixity,
    whitening,
)
from tracemill.llm.common import read_table
from tracemill.llm.registry import query

EXACT_SQL = r"""
WITH base AS (
  SELECT doc_id, coalesce(length(text), 0) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS kept,
       text_sha256
FROM base
"""


@query("op10_exact_dedup", EXACT_SQL)
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.refine(read_table(spark, sf_dir, "documents"), digest_all=True)


@query("op5_mixing")
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


@query("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


@query("op8_outliers")
def op8_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judge(read_table(spark, sf_dir, "documents"))


@query("op1_simhash")
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


@query("op2_html_text")
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages"))


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.fit(docs, labels))


@query("op4_substring_dedup")
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(read_table(spark, sf_dir, "documents"))


#: The key of a deployment comes from its own secret store; results over the given tables use this one.
QUERY_KEY = b"surrogates of the given tables"


@query("op7_surrogates")
def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.pseudonymise(read_table(spark, sf_dir, "documents"), QUERY_KEY)


# The second replica is the first with a byte in the middle of every 97th page replaced and every 101st page lost.
FIXITY_SQL = r"""
WITH records AS (
  SELECT page_id, CAST(floor(page_id / 1000.0) AS BIGINT) AS archive,
         strlen('WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ')
         + strlen(coalesce(url, '')) + strlen(chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
         || 'Content-Length: ') + strlen(CAST(strlen(coalesce(html, '')) AS VARCHAR)) + 4
         + strlen(coalesce(html, '')) + 4 AS length
  FROM pages
), placed AS (
  SELECT *, coalesce(sum(length) OVER (PARTITION BY archive ORDER BY page_id
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset"
  FROM records
)
SELECT archive, CAST("offset" AS BIGINT) AS "offset", length AS length_a,
       CASE WHEN page_id % 101 = 7 THEN NULL ELSE length END AS length_b,
       CASE WHEN page_id % 101 = 7 THEN 'missing' ELSE 'changed' END AS status
FROM placed WHERE page_id % 101 = 7 OR page_id % 97 = 13
"""


@query("op6_warc_fixity", FIXITY_SQL)
def op6_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc_fixity.warc_records(read_table(spark, sf_dir, "pages"))
    middle = F.floor(F.col("length") / 2).cast("int")
    flipped = F.overlay("record", F.encode(F.lit("\x00"), "UTF-8"), middle, F.lit(1))
    altered = F.when(F.col("page_id") % 97 == 13, flipped).otherwise(F.col("record"))
    both = warc_fixity.placed(records.select(
        "archive", "page_id", "length", warc_fixity.digest(F.col("record")).alias("first"), warc_fixity.digest(altered).alias("second")))
    place = ["archive", "offset", "length"]
    kept = both.where("page_id % 101 <> 7")
    return warc_fixity.audit(both.select(*place, F.col("first").alias("digest")), kept.select(*place, F.col("second").alias("digest")))


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


# Windows of both sides as text, joined by length and words; items of fewer words than a window are one window.
LEAKS_SQL = r"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(10, len(ws)) AS m, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS w
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM items WHERE len(ws) > 0)
), docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), places AS (
  SELECT r, i, m, array_to_string(ws[i:i + m - 1], ' ') AS w
  FROM (SELECT r, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM docs, (SELECT DISTINCT m FROM windows) WHERE len(ws) >= m)
), hits AS (
  SELECT r, i, places.m, item FROM places JOIN windows ON places.m = windows.m AND places.w = windows.w
), marked AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM hits) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN marked ON docs.r = marked.r LEFT JOIN named ON docs.r = named.r
"""


@query("op11_decontamination", LEAKS_SQL)
def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.scan(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.concat_ws(",", "items"), "UTF-8"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


# Every phrase length exploded on its own; HUGEINT holds the products.
COLLOCATIONS_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), split AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces
), sizes AS (
  SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM split GROUP BY lang
), phrases AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM split, range(1, 6) AS sizes(k) WHERE len(ws) >= k)
  GROUP BY ALL HAVING count(*) >= 100
), candidates AS (
  SELECT lang, k AS size, phrase, string_split(phrase, ' ') AS ws, f AS a FROM phrases WHERE k > 1
), cuts AS (
  SELECT c.lang, c.phrase, c.size, c.a, n, c.k, l.f AS l, r.f AS r,
         CAST((CAST(1000 AS HUGEINT) * c.a * n) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) c JOIN sizes ON c.lang = sizes.lang
  JOIN phrases l ON l.lang = c.lang AND l.k = c.k AND l.phrase = array_to_string(c.ws[1:c.k], ' ')
  JOIN phrases r ON r.lang = c.lang AND r.k = c.size - c.k AND r.phrase = array_to_string(c.ws[c.k + 1:], ' ')
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS most
  FROM (SELECT *, unnest(range(1, size - m + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS m FROM candidates)) GROUP BY ALL
)
SELECT best.lang, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.phrase) AS rank,
       best.phrase, a, l, r, n, score
FROM best LEFT JOIN inside ON best.lang = inside.lang AND best.phrase = inside.phrase
WHERE NOT 100 * coalesce(most, 0) >= 100 * a
QUALIFY row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.phrase) <= 2000
"""


@query("op12_collocations", COLLOCATIONS_SQL)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))
