"""The registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

import secrets
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontam, htmltext, langid, lmscore, neardup, packing, pii, quality, warc
from .runtime import shared_dir, table


def pii_key(spark: SparkSession) -> str:
    """The key that the session sets, or a new one: pseudonyms are then linked within one result and can't be turned back later."""
    return spark.conf.get("spark.lexigrid.pii.key", None) or secrets.token_hex(32)


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), pii_key(spark)).select("doc_id", "text", "n_pii")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lmscore.score(docs, lmscore.fit(docs))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_text(table(spark, sf_dir, "pages"))


def op5_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op6_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    found = warc.read_archives(spark, folder, payloads=False)
    # These archives were written just now: a gap is an error here, not a row to leave out.
    whole = F.when(F.col("gap").isNull(), True).otherwise(F.raise_error(F.concat_ws(" ", F.lit("damaged:"), "path", "gap")).cast("boolean"))
    return found.filter(whole).select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_pii_pseudonyms, op2_near_duplicates, op3_pseudo_likelihood, op4_main_text, op5_nearest_vectors, op6_packed_sequences, op7_contamination, op8_warc_round_trip, op9_language, op10_quality)
}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (
  SELECT doc_id, array_to_string(w[k:k + least(len(w), 5) - 1], ' ') AS sh, count(*) AS c
  FROM d, unnest(range(1, len(w) - least(len(w), 5) + 2)) t(k) WHERE len(w) > 0 GROUP BY ALL),
n AS (SELECT doc_id, CAST(sum(c) AS BIGINT) AS n FROM s GROUP BY doc_id),
o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.c, b.c)) AS shared
  FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE shared >= 0.8 * (x.n + y.n - shared)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
t AS (SELECT doc_id, md5(string_agg(sh || '#' || c, '|' ORDER BY sh)) AS bag FROM s GROUP BY doc_id),
reach(node, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.node, g.b FROM reach r JOIN both_ways g ON g.a = r.other)
SELECT node AS doc_id, min(other) AS class_id, coalesce(any_value(n.n), 0) AS n_shingles,
  CAST(greatest(count(DISTINCT bag) - 1, 0) AS BIGINT) AS n_links, node = min(other) AS is_kept
FROM reach LEFT JOIN n ON n.doc_id = node LEFT JOIN t ON t.doc_id = other GROUP BY node
"""

OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 8) AS n, array_to_string(w[k:k + least(len(w), 8) - 1], ' ') AS span
  FROM i, unnest(range(1, len(w) - least(len(w), 8) + 2)) t(k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT rid, n, k, array_to_string(w[k:k + n - 1], ' ') AS span FROM d, sizes, unnest(range(1, len(w) - n + 2)) t(k)),
m AS (SELECT DISTINCT rid, k, n, item_id FROM dw JOIN iw USING (n, span)),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM m, unnest(range(k, k + n)) t(p) GROUP BY rid),
q AS (
  SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN q USING (rid)
"""

ORACLE_SQL = {"op2_near_duplicates": OP2_SQL, "op7_contamination": OP7_SQL}
