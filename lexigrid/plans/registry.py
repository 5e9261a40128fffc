"""Registered queries by name, and their SQL.

Each query applies an operator to the whole test tables through ``testmodel``.
Doubles are rounded to six places here, on both sides, and nowhere else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.functions import stats as st
from lexigrid.functions import text as tx
from lexigrid.operators import clusters as cl
from lexigrid.operators import hierarchy as hi
from lexigrid.operators import quality as qu
from lexigrid.operators import search as se
from lexigrid.operators import trends as tr
from lexigrid.operators import vectors as ve
from lexigrid.plans import testmodel as tm
from lexigrid.plans.testmodel import ASSIGN_SQL, PAPERS_SQL, REMAP_SQL, prelude, table
from lexigrid.runtime import prepare
from lexigrid.sources import records

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
P, PA, PAR = prelude(PAPERS_SQL), prelude(PAPERS_SQL, ASSIGN_SQL), prelude(PAPERS_SQL, ASSIGN_SQL, REMAP_SQL)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column | str, name: str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


def trend(spark: SparkSession, d: str) -> DataFrame:
    """Papers with remapped clusters and their trend category."""
    return hi.with_category(hi.remap_orphans(tm.assignments(spark, d)), tm.mega_names(spark)).join(tm.papers(spark, d).select("doc_id", "venue", "year"), "doc_id")


def complete(spark: SparkSession, d: str) -> DataFrame:
    return trend(spark, d).filter(F.col("year") <= tm.LAST_COMPLETE)


def cell_table(spark: SparkSession, d: str) -> DataFrame:
    return tr.cells(complete(spark, d))


#: Cells of the trend table: every category in every venue-year with labelled papers.
CELLS = PAR + """,
t AS (SELECT * FROM trend WHERE year <= 2024),
k AS (SELECT venue, year, category, count(*) AS k FROM t WHERE category <> 'Unclustered' GROUP BY ALL),
vy AS (SELECT venue, year, CAST(sum(k) AS BIGINT) AS n FROM k GROUP BY ALL),
cats AS (SELECT DISTINCT category FROM k),
cells AS (
  SELECT venue, year, category, coalesce(k.k, 0) AS k, n
  FROM vy CROSS JOIN cats LEFT JOIN k USING (venue, year, category)),
tot AS (SELECT category, CAST(sum(k) AS BIGINT) AS total FROM cells GROUP BY category),
top2 AS (SELECT category FROM tot ORDER BY total DESC, category LIMIT 2),
other AS (
  SELECT venue, year, CASE WHEN category IN (SELECT category FROM top2) THEN category ELSE 'Other' END AS category,
    CAST(sum(k) AS BIGINT) AS k, max(n) AS n FROM cells GROUP BY ALL),
wil AS (
  SELECT *, 1.959964 * sqrt(p * (1 - p) / n + 1.959964 * 1.959964 / (4 * n * n)) / (1 + 1.959964 * 1.959964 / n) AS half
  FROM (SELECT *, k / CAST(n AS DOUBLE) AS p FROM other)),
pts AS (
  SELECT *, CASE WHEN k = 0 THEN 'hide' WHEN half / p > 1 THEN 'hide' WHEN half / p > 0.5 THEN 'grey' ELSE 'ok' END AS status
  FROM wil)"""

# --- scans, keys, filters ---------------------------------------------------------------


@query(P + " SELECT paper_id, title, venue, year, source FROM papers")
def scan_corpus(spark, d):
    return tm.papers(spark, d).select("paper_id", "title", "venue", "year", "source")


@query("SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def dup_key_check(spark, d):
    return qu.duplicate_keys(table(spark, d, "documents"), "text")


@query("SELECT lang, source, n_chars FROM documents WHERE n_chars > 1000")
def pruned_scan(spark, d):
    return table(spark, d, "documents").select("lang", "source", "n_chars").filter("n_chars > 1000")


@query("SELECT vec_id, len(embedding) AS dim, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS norm FROM embeddings")
def scan_vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("dim"), r6(st.l2_norm(F.col("embedding")), "norm"))


_HITS = " + ".join(f"{w} * (CASE WHEN contains({f}, '{t}') THEN 1 ELSE 0 END)" for w, f in ((4, "lower(title)"), (3, "lower(author)"), (2, "lower(array_to_string(keywords, ' '))"), (1, "lower(abstract)")) for t in ("the", "and"))
_ALL = " AND ".join(f"(contains(lower(title), '{t}') OR contains(lower(author), '{t}') OR contains(lower(array_to_string(keywords, ' ')), '{t}') OR contains(lower(abstract), '{t}'))" for t in ("the", "and"))
_FOUND = P + f", found AS (SELECT *, {_HITS} + CASE WHEN contains(lower(title), 'the and') THEN 8 ELSE 0 END AS score FROM papers WHERE {_ALL})"


@query(_FOUND + " SELECT paper_id, CAST(score AS INTEGER) AS score, year, (SELECT count(*) FROM found) AS total_matches FROM found ORDER BY score DESC, year DESC, paper_id LIMIT 20")
def search_ranked(spark, d):
    return se.search(tm.papers(spark, d), "the and", limit=20).select("paper_id", "score", "year", "total_matches")


@query(_FOUND + " SELECT paper_id, CAST(score AS INTEGER) AS score, (SELECT count(*) FROM found WHERE venue = 'en' AND year = 2020) AS total_matches FROM found WHERE venue = 'en' AND year = 2020 ORDER BY score DESC, paper_id LIMIT 10")
def search_filtered(spark, d):
    return se.search(tm.papers(spark, d), "The AND".lower(), venue="EN", year=2020).select("paper_id", "score", "total_matches")


@query(P + f" SELECT paper_id FROM papers WHERE {_ALL}")
def search_and(spark, d):
    p = tm.papers(spark, d)
    fields = se.folded_fields()
    return p.filter(tx.holds_all(list(fields.values()), ["the", "and"])).select("paper_id")


_PEERS = PA + ", mine AS (SELECT leaf FROM assigned WHERE doc_id = 5), peers AS (SELECT p.* FROM papers p JOIN assigned a USING (doc_id) JOIN mine USING (leaf) WHERE p.doc_id <> 5 AND leaf >= 0)"


@query(_PEERS + " SELECT paper_id, year, (SELECT count(*) FROM peers) AS total_cluster_peers FROM peers ORDER BY year DESC, paper_id LIMIT 10")
def related_papers(spark, d):
    """Peers of one document, named by its id in the corpus."""
    p = tm.papers(spark, d)
    a = tm.assignments(spark, d).join(p.select("doc_id", "paper_id"), "doc_id")
    mine = p.filter("doc_id = 5").select("paper_id").first()[0]
    return se.related(p, a, mine).select("paper_id", "year", "total_cluster_peers")


@query(PA + " SELECT paper_id, abstract, CASE WHEN leaf >= 0 AND leaf < 8 THEN 'Leaf ' || leaf END AS leaf_label, leaf >= 0 AS has_leaf FROM papers JOIN assigned USING (doc_id) WHERE doc_id = 7")
def single_paper(spark, d):
    p = tm.papers(spark, d)
    a = tm.assignments(spark, d).join(p.select("doc_id", "paper_id"), "doc_id")
    mine = p.filter("doc_id = 7").select("paper_id").first()[0]
    return se.get_paper(p, a, tm.leaf_names(spark), mine).select("paper_id", "abstract", F.col("leaf_cluster.label").alias("leaf_label"), F.col("leaf_cluster").isNotNull().alias("has_leaf"))


@query(P + """, c AS (SELECT paper_id, abstract, instr(lower(abstract), 'the') - 1 AS pos FROM papers)
SELECT paper_id, CASE WHEN length(abstract) > 320 AND pos >= 0 THEN (CASE WHEN greatest(0, pos - 80) > 0 THEN '…' ELSE '' END) || substr(abstract, greatest(0, pos - 80) + 1, 320)
  || (CASE WHEN greatest(0, pos - 80) + 320 < length(abstract) THEN '…' ELSE '' END) ELSE substr(abstract, 1, 320) END AS excerpt FROM c""")
def paper_summary(spark, d):
    p = tm.papers(spark, d)
    return p.select("paper_id", tx.excerpt(F.col("abstract"), F.lower("abstract"), ["the"]).alias("excerpt"))


@query(P + " SELECT paper_id, title FROM papers WHERE NOT starts_with(paper_id, 'en:')")
def prefix_invalidate(spark, d):
    from lexigrid.sources.corpus import without_prefix

    return without_prefix(tm.papers(spark, d), "en:").select("paper_id", "title")


@query(r"SELECT page_id, regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1) AS part FROM pages WHERE regexp_matches(regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1), '^\s*\d')")
def paper_row_filter(spark, d):
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"([^/?#]*)(?:[?#].*)?$", 1).alias("part"))
    return p.filter(qu.front_matter("part"))


_BROWSE = PAR + ", b AS (SELECT paper_id, title, venue, year, mega FROM papers JOIN remapped USING (doc_id))"


@query(_BROWSE + " SELECT * FROM b WHERE contains(lower(title), 'th') AND venue = 'en' AND mega = 0 ORDER BY year DESC, paper_id LIMIT 20 OFFSET 20")
def browse_page(spark, d):
    b = tm.papers(spark, d).join(hi.remap_orphans(tm.assignments(spark, d)).select("doc_id", "mega"), "doc_id").select("paper_id", "title", "venue", "year", "mega")
    return se.browse(b, text="th", venue="en", mega="0", page=1, size=20)


_MAP = PAR + """, pts AS (
  SELECT p.doc_id, coalesce(CASE WHEN leaf = -1 THEN 'Unclustered' WHEN leaf < 8 THEN 'Leaf ' || leaf END, '?') || ' ' || array_to_string(keywords, ' ') || ' ' || title AS search_text,
    CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y
  FROM papers p JOIN remapped USING (doc_id) JOIN embeddings ON vec_id = p.doc_id)"""


def _points(spark: SparkSession, d: str) -> DataFrame:
    named = hi.with_names(hi.remap_orphans(tm.assignments(spark, d)), tm.leaf_names(spark), tm.mid_names(spark), tm.mega_names(spark))
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    return tm.papers(spark, d).join(named, "doc_id").join(e, "doc_id").select("doc_id", F.concat_ws(" ", "leaf_name", F.array_join(F.array_sort("keywords"), " "), "title").alias("search_text"), "x", "y")


@query(_MAP + " SELECT doc_id FROM pts WHERE contains(lower(search_text), 'leaf 3')")
def map_search(spark, d):
    return se.map_search(_points(spark, d), "Leaf 3").select("doc_id")


@query(_MAP + """, f AS (SELECT * FROM pts WHERE contains(lower(search_text), 'leaf 3'))
SELECT (SELECT count(*) FROM f) AS n, (SELECT min(x) FROM f) AS min_x, (SELECT max(x) FROM f) AS max_x, (SELECT min(y) FROM f) AS min_y, (SELECT max(y) FROM f) AS max_y,
  (SELECT count(*) <= 12 AND count(*) > 0 AND max(x) - min(x) <= 0.15 * (SELECT max(x) - min(x) FROM pts) AND max(y) - min(y) <= 0.15 * (SELECT max(y) - min(y) FROM pts) FROM f) AS compact""")
def match_bbox(spark, d):
    p = _points(spark, d)
    return se.bounding_box(p, se.map_search(p, "leaf 3"))


@query("SELECT CAST(i AS INTEGER) AS cluster_id, 'Leaf ' || i AS label FROM range(8) t(i) WHERE contains(lower('Leaf ' || i), 'leaf')")
def label_search(spark, d):
    return se.label_search(tm.leaf_names(spark), "  LEAF ")


# --- joins and hierarchy ------------------------------------------------------------------


@query(PA + " SELECT paper_id, leaf, mid, mega FROM papers JOIN assigned USING (doc_id)")
def paper_cluster_join(spark, d):
    return tm.labelled(spark, d).select("paper_id", "leaf", "mid", "mega")


_NAMES = PAR + """, named AS (
  SELECT doc_id, CASE WHEN leaf = -1 THEN 'Unclustered' WHEN leaf < 8 THEN 'Leaf ' || leaf ELSE '?' END AS leaf_name,
    CASE mid WHEN -1 THEN 'Unclustered' WHEN -2 THEN 'Specialized / Niche Topics' ELSE 'Topic ' || mid END AS mid_name,
    CASE mega WHEN -1 THEN 'Unclustered' WHEN -3 THEN 'Cross-Cutting & Specialized Research' ELSE 'Area ' || mega END AS mega_name FROM remapped)"""


def _named(spark: SparkSession, d: str) -> DataFrame:
    return hi.with_names(hi.remap_orphans(tm.assignments(spark, d)), tm.leaf_names(spark), tm.mid_names(spark), tm.mega_names(spark))


@query(_NAMES + " SELECT * FROM named")
def hierarchy_names(spark, d):
    return _named(spark, d).select("doc_id", "leaf_name", "mid_name", "mega_name")


@query(PAR + " SELECT doc_id, leaf, mid, mega FROM remapped")
def orphan_remap(spark, d):
    return hi.remap_orphans(tm.assignments(spark, d)).select("doc_id", "leaf", "mid", "mega")


_TREE = """SELECT mega_name, mid_name, leaf_name, count(*) AS n,
  CASE grouping(mega_name) + grouping(mid_name) + grouping(leaf_name) WHEN 3 THEN 0 WHEN 2 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS depth
FROM named GROUP BY ROLLUP (mega_name, mid_name, leaf_name)"""


@query(_NAMES + " " + _TREE)
def topic_tree(spark, d):
    return hi.topic_tree(_named(spark, d))


@query(_NAMES + f" SELECT * FROM ({_TREE}) WHERE depth < 3 OR mid_name <> 'Unclustered' OR leaf_name <> 'Unclustered'")
def topic_tree_pruned(spark, d):
    return hi.without_repeats(hi.topic_tree(_named(spark, d)), hi.UNCLUSTERED)


@query("""SELECT doc_id AS id, 'left' AS only_in FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
UNION ALL SELECT vec_id, 'right' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)""")
def id_set_mismatch(spark, d):
    return qu.id_mismatch(table(spark, d, "documents").select(F.col("doc_id").alias("id")), table(spark, d, "embeddings").select(F.col("vec_id").alias("id")), "id")


_KEYS = r"""WITH s AS (SELECT doc_id, lang, unnest(string_split(text, '.')) AS x FROM documents),
ours AS (SELECT doc_id, lang, trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')) AS key FROM s),
o AS (SELECT DISTINCT lang, key FROM ours WHERE length(key) > 20),
b AS (SELECT DISTINCT trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')) AS key FROM (SELECT unnest(string_split(text, '.')) AS x FROM benchmark)),
t AS (SELECT lang, key FROM (SELECT DISTINCT lang FROM documents), b WHERE length(key) > 20)"""


def _sentences(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, F.explode(F.split("text", r"\.")).alias("x")).select(*keep, tx.ascii_key(F.col("x")).alias("key")).filter(F.length("key") > 20)


@query(_KEYS + " SELECT DISTINCT doc_id FROM ours WHERE length(key) > 20 AND key IN (SELECT key FROM b)")
def accept_semi(spark, d):
    return qu.accepted(_sentences(table(spark, d, "documents"), "doc_id"), _sentences(table(spark, d, "benchmark")), "key").select("doc_id").distinct()


@query(_KEYS + """, j AS (SELECT coalesce(o.lang, t.lang) AS lang, o.key AS a, t.key AS c FROM o FULL JOIN t ON o.lang = t.lang AND o.key = t.key)
SELECT lang, count(a) AS n_ours, count(c) AS n_theirs, count(CASE WHEN a IS NOT NULL AND c IS NOT NULL THEN 1 END) AS matched,
  round(count(CASE WHEN a IS NOT NULL AND c IS NOT NULL THEN 1 END) / nullif(CAST(count(c) AS DOUBLE), 0), 6) AS recall,
  round(count(CASE WHEN a IS NOT NULL AND c IS NOT NULL THEN 1 END) / nullif(CAST(count(a) AS DOUBLE), 0), 6) AS confirmation FROM j GROUP BY lang""")
def recall_by_year(spark, d):
    docs = table(spark, d, "documents")
    out = qu.agreement_with_all(_sentences(docs, "lang"), _sentences(table(spark, d, "benchmark")), docs, "lang", "key")
    return out.select("lang", "n_ours", "n_theirs", "matched", r6("recall", "recall"), r6("confirmation", "confirmation"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def missing_vectors(spark, d):
    return qu.missing(table(spark, d, "documents").select("doc_id"), table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")


_ABSENT = "a(venue, year, note) AS (VALUES ('en', 2026, 'not yet'), ('it', 2020, 'not held'), ('de', 2018, 'present after all'))"


def _absent(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("en", 2026, "not yet"), ("it", 2020, "not held"), ("de", 2018, "present after all")], "venue string, year int, note string")


@query(prelude(PAPERS_SQL, _ABSENT) + """, v AS (SELECT DISTINCT venue FROM papers UNION SELECT 'it'), y AS (SELECT CAST(2018 + i AS INTEGER) AS year FROM range(9) t(i))
SELECT v.venue, y.year, coalesce(a.note, 'unexpected') AS note FROM v CROSS JOIN y LEFT JOIN a ON a.venue = v.venue AND a.year = y.year
WHERE NOT EXISTS (SELECT 1 FROM papers p WHERE p.venue = v.venue AND p.year = y.year)""")
def absent_cells(spark, d):
    p = tm.papers(spark, d)
    venues = p.select("venue").distinct().unionByName(spark.createDataFrame([("it",)], "venue string"))
    return qu.absent_cells(p, venues, spark.range(2018, 2027).select(F.col("id").cast("int").alias("year")), _absent(spark))


_COVER = "cover AS (SELECT venue, year, count(*) AS n_papers, count(CASE WHEN length(trim(abstract)) > 0 THEN 1 END) AS n_with_abstract, count(CASE WHEN len(keywords) > 0 THEN 1 END) AS n_with_keywords, min(source) AS source FROM papers GROUP BY venue, year)"


@query(prelude(PAPERS_SQL, _COVER) + " SELECT * FROM cover")
def manifest_counts(spark, d):
    return qu.coverage(tm.papers(spark, d))


@query(prelude(PAPERS_SQL, _COVER, _ABSENT) + """ SELECT *, true AS complete, CAST(NULL AS VARCHAR) AS note FROM cover
UNION ALL SELECT venue, year, 0, 0, 0, NULL, false, note FROM a WHERE NOT EXISTS (SELECT 1 FROM cover c WHERE c.venue = a.venue AND c.year = a.year)""")
def manifest(spark, d):
    return qu.manifest(tm.papers(spark, d), _absent(spark))


@query(P + ", e(venue, year, expected) AS (VALUES ('en', 2018, 50), ('de', 2019, 20), ('it', 2018, 5)) SELECT e.venue, e.year, e.expected, count(p.doc_id) AS n_papers, count(p.doc_id) - e.expected AS drift FROM e LEFT JOIN papers p ON p.venue = e.venue AND p.year = e.year GROUP BY e.venue, e.year, e.expected")
def drift_report(spark, d):
    return qu.drift(tm.papers(spark, d), spark.createDataFrame([("en", 2018, 50), ("de", 2019, 20), ("it", 2018, 5)], "venue string, year int, expected int"))


# --- trends -----------------------------------------------------------------------------------


@query(P + " SELECT venue, year, count(*) AS n FROM papers GROUP BY venue, year")
def venue_year_counts(spark, d):
    return tr.count_by(tm.papers(spark, d), "venue", "year")


_SHARES = PAR + ", c AS (SELECT year, category, count(*) AS n FROM trend WHERE category <> 'Unclustered' AND year <= 2024 GROUP BY ALL), s AS (SELECT *, 100 * n / CAST(sum(n) OVER (PARTITION BY year) AS DOUBLE) AS share FROM c)"


def _shares(spark: SparkSession, d: str) -> DataFrame:
    return tr.share_within(tr.count_by(complete(spark, d).filter(F.col("category") != hi.UNCLUSTERED), "year", "category"), ["year"])


@query(_SHARES + " SELECT year, category, n, round(share, 6) AS share FROM s")
def share_by_year(spark, d):
    return _shares(spark, d).select("year", "category", "n", r6("share", "share"))


@query(_SHARES + """ SELECT year, round(coalesce(max(CASE WHEN category = 'Area 0' THEN share END), 0), 6) AS area_0, round(coalesce(max(CASE WHEN category = 'Area 1' THEN share END), 0), 6) AS area_1,
  round(coalesce(max(CASE WHEN category LIKE 'Cross%' THEN share END), 0), 6) AS cross_cutting FROM s GROUP BY year""")
def share_pivot(spark, d):
    wide = tr.pivoted(_shares(spark, d), "year", "category", ["Area 0", "Area 1", hi.CROSS_CUTTING], "share", 0.0)
    return wide.select("year", r6("Area 0", "area_0"), r6("Area 1", "area_1"), r6(hi.CROSS_CUTTING, "cross_cutting"))


@query(_SHARES + " SELECT category, round(sum(share), 6) AS total FROM s GROUP BY category")
def series_order(spark, d):
    return _shares(spark, d).groupBy("category").agg(r6(F.sum("share"), "total")).orderBy(F.desc("total"))


_VY = PAR + ", vy AS (SELECT venue, year, count(*) AS n_total, count(CASE WHEN category <> 'Unclustered' THEN 1 END) AS n_labeled FROM trend WHERE year <= 2024 GROUP BY venue, year)"


@query(_VY + " SELECT venue, year, n_total, n_labeled, n_total - n_labeled AS n_noise, round((n_total - n_labeled) / CAST(n_total AS DOUBLE), 6) AS noise_rate FROM vy")
def noise_rate(spark, d):
    return tr.venue_years(complete(spark, d)).select("venue", "year", "n_total", "n_labeled", "n_noise", r6("noise_rate", "noise_rate"))


@query(_VY + " SELECT venue, " + ", ".join(f"round(max(CASE WHEN year = {y} THEN (n_total - n_labeled) / CAST(n_total AS DOUBLE) END), 6) AS y{y}" for y in range(2018, 2025)) + " FROM vy GROUP BY venue")
def noise_pivot(spark, d):
    wide = tr.pivoted(tr.venue_years(complete(spark, d)), "venue", "year", list(range(2018, 2025)), "noise_rate")
    return wide.select("venue", *(r6(str(y), f"y{y}") for y in range(2018, 2025)))


@query(_VY + " SELECT venue, min(n_labeled) AS min, CAST(median(n_labeled) AS DOUBLE) AS median, max(n_labeled) AS max FROM vy GROUP BY venue")
def denominator_stats(spark, d):
    return tr.denominators(tr.venue_years(complete(spark, d)))


@query(CELLS + " SELECT venue, year, category, k, n FROM cells")
def long_cells(spark, d):
    return cell_table(spark, d)


@query(CELLS + " SELECT category, total FROM tot ORDER BY total DESC, category LIMIT 2")
def top_categories(spark, d):
    return tr.top_categories(cell_table(spark, d), 2)


def _other(spark: SparkSession, d: str) -> DataFrame:
    cell = cell_table(spark, d)
    return tr.collapse(cell, tr.top_categories(cell, 2))


@query(CELLS + " SELECT venue, year, category, k, n FROM other")
def topn_other(spark, d):
    return _other(spark, d)


@query(CELLS + """, v AS (SELECT venue, category, sum(k) AS k FROM cells GROUP BY ALL), s AS (SELECT *, 100 * k / CAST(sum(k) OVER (PARTITION BY venue) AS DOUBLE) AS pct FROM v)
SELECT venue, category, round(pct, 6) AS venue_pct, round(100 * total / CAST((SELECT sum(total) FROM tot) AS DOUBLE), 6) AS pooled_pct,
  round(pct - 100 * total / CAST((SELECT sum(total) FROM tot) AS DOUBLE), 6) AS gap_pp FROM s JOIN tot USING (category)""")
def venue_vs_pooled(spark, d):
    return tr.venue_against_pool(cell_table(spark, d)).select("venue", "category", r6("venue_pct", "venue_pct"), r6("pooled_pct", "pooled_pct"), r6("gap_pp", "gap_pp"))


@query(CELLS + """, w AS (SELECT *, CAST(2018 + 2 * ((year - 2018) // 2) AS INTEGER) AS first FROM cells)
SELECT venue, first AS year, category, CAST(sum(k) AS BIGINT) AS k, CAST(sum(n) AS BIGINT) AS n, count(DISTINCT w.year) AS n_years_present FROM w GROUP BY venue, first, category""")
def two_year_bins(spark, d):
    return tr.binned(cell_table(spark, d)).select("venue", "year", "category", "k", "n", "n_years_present")


@query(CELLS + " SELECT count(k) AS count, round(avg(k), 6) AS mean, round(stddev_samp(k), 6) AS std, min(k) AS min, round(quantile_cont(k, 0.25), 6) AS q25, round(quantile_cont(k, 0.5), 6) AS q50, round(quantile_cont(k, 0.75), 6) AS q75, max(k) AS max FROM cells")
def cell_describe(spark, d):
    return tr.described(cell_table(spark, d)).select("count", r6("mean", "mean"), r6("std", "std"), "min", r6("q25", "q25"), r6("q50", "q50"), r6("q75", "q75"), "max")


@query(CELLS + " SELECT venue, count(*) AS cells, count(CASE WHEN k < 10 THEN 1 END) AS under10, count(CASE WHEN k < 30 THEN 1 END) AS under30, count(CASE WHEN k = 0 THEN 1 END) AS zero, round(avg(CASE WHEN k < 10 THEN 1.0 ELSE 0 END), 6) AS part_under10, round(avg(CASE WHEN k < 30 THEN 1.0 ELSE 0 END), 6) AS part_under30 FROM cells GROUP BY venue")
def cells_under_n(spark, d):
    return tr.small_cells(cell_table(spark, d), ["venue"]).select("venue", "cells", "under10", "under30", "zero", r6("part_under10", "part_under10"), r6("part_under30", "part_under30"))


_RULES = {"n_under30": "n < 30", "n_under50": "n < 50", "n_under100": "n < 100", "wilson_over5": "100 * half > 5", "wilson_over10": "100 * half > 10", "k_under30": "k < 30", "rel_over25": "k = 0 OR half / p > 0.25", "rel_over50": "k = 0 OR half / p > 0.5", "rel_over100": "k = 0 OR half / p > 1"}


@query(CELLS + " SELECT venue, " + ", ".join(f"round(100 * avg(CASE WHEN {t} THEN 1.0 ELSE 0 END), 6) AS {name}" for name, t in _RULES.items()) + " FROM wil GROUP BY venue")
def rule_table(spark, d):
    return tr.rules(_other(spark, d)).select("venue", *(r6(name, name) for name in _RULES))


@query(CELLS + ", m AS (SELECT *, row_number() OVER (PARTITION BY venue, year ORDER BY k DESC, category) AS r FROM cells) SELECT venue, year, category, round(100 * k / CAST(n AS DOUBLE), 6) AS largest_pct FROM m WHERE r = 1")
def largest_bucket(spark, d):
    return tr.largest_bucket(cell_table(spark, d)).select("venue", "year", "category", r6("largest_pct", "largest_pct"))


@query(CELLS + " SELECT venue, year, category, k, n, round(100 * p, 6) AS share, round(100 * half, 6) AS half_pp, status FROM pts")
def wilson_status(spark, d):
    return tr.points(_other(spark, d)).select("venue", "year", "category", "k", "n", r6("share", "share"), r6("half_pp", "half_pp"), "status")


@query(CELLS + """, l AS (SELECT *, lag(status) OVER w AS before, lag(year) OVER w AS last FROM pts WINDOW w AS (PARTITION BY venue, category ORDER BY year))
SELECT venue, category, last AS from_year, year AS to_year, CASE WHEN status = 'grey' OR before = 'grey' THEN 'grey' ELSE 'solid' END AS style FROM l WHERE last = year - 1 AND status <> 'hide' AND before <> 'hide'""")
def trend_segments(spark, d):
    return tr.segments(tr.points(_other(spark, d))).drop("run")


@query(CELLS + """, u AS (SELECT venue, avg(CASE WHEN status <> 'ok' THEN 1.0 ELSE 0 END) AS unreliable FROM pts GROUP BY venue),
z AS (SELECT venue, category, sum(k) AS k, 100 * sum(k) / CAST(sum(sum(k)) OVER (PARTITION BY venue) AS DOUBLE) AS pct FROM pts GROUP BY venue, category),
m AS (SELECT *, row_number() OVER (PARTITION BY venue ORDER BY k DESC, category) AS r FROM z)
SELECT u.venue, round(unreliable, 6) AS unreliable, unreliable > 0.5 AS warn, category AS largest, round(pct, 6) AS largest_pct FROM u JOIN m ON m.venue = u.venue AND r = 1""")
def reliability_notes(spark, d):
    return tr.reliability_notes(tr.points(_other(spark, d))).select("venue", r6("unreliable", "unreliable"), "warn", "largest", r6("largest_pct", "largest_pct"))


@query(P + ", c AS (SELECT year, venue, count(*) AS n FROM papers GROUP BY year, venue) SELECT year, venue, n, round(100 * n / CAST(sum(n) OVER (PARTITION BY year) AS DOUBLE), 6) AS share FROM c")
def venue_share_by_year(spark, d):
    return tr.share_within(tr.count_by(tm.papers(spark, d), "year", "venue"), ["year"]).select("year", "venue", "n", r6("share", "share"))


@query(PAR + " SELECT count(DISTINCT venue) AS venues, count(DISTINCT year) AS years, count(DISTINCT mega) AS megas FROM trend")
def distinct_dims(spark, d):
    return trend(spark, d).agg(F.countDistinct("venue").alias("venues"), F.countDistinct("year").alias("years"), F.countDistinct("mega").alias("megas"))


@query(P + " SELECT make_date(year, 1, 1) AS date, count(*) AS n FROM papers GROUP BY 1")
def year_histogram(spark, d):
    return tr.year_histogram(tm.papers(spark, d))


_ENTRIES = "'{{' || string_agg(to_json(category) || ':' || CAST({} AS VARCHAR), ',' ORDER BY category) || '}}'"


@query(CELLS + f""" SELECT venue, year, '{{"venue":' || to_json(venue) || ',"year":' || year || ',"n_labeled":' || max(n) || ',"counts":' || {_ENTRIES.format("k")} || ',"shares":' || {_ENTRIES.format("100 * (k / CAST(n AS DOUBLE))")} || '}}' AS doc
FROM cells GROUP BY venue, year""")
def analytics_rows(spark, d):
    return tr.analytics_rows(cell_table(spark, d))


# --- clusters ---------------------------------------------------------------------------------


@query(PA + " SELECT leaf, count(*) AS n FROM assigned WHERE leaf >= 0 GROUP BY leaf")
def cluster_sizes(spark, d):
    return cl.sizes(tm.assignments(spark, d))


@query(PA + ", c AS (SELECT leaf, count(*) AS n FROM assigned GROUP BY leaf) SELECT count(CASE WHEN leaf >= 0 THEN 1 END) AS clusters, round(sum(CASE WHEN leaf < 0 THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE), 6) AS noise, CAST(median(CASE WHEN leaf >= 0 THEN n END) AS DOUBLE) AS median_size, max(CASE WHEN leaf >= 0 THEN n END) AS max_size FROM c")
def cluster_summary(spark, d):
    return cl.summary(tm.assignments(spark, d)).select("clusters", r6("noise", "noise"), "median_size", "max_size")


_TERMS = "list_filter(regexp_extract_all(lower(abstract), '[a-z][a-z0-9-]{2,}'), lambda w: NOT list_contains([" + ", ".join(f"'{w}'" for w in tx.TERM_STOP_WORDS) + "], w))"


_SCORED = f""", t AS (SELECT leaf, unnest({_TERMS}) AS term FROM papers JOIN assigned USING (doc_id) WHERE leaf >= 0),
tf AS (SELECT leaf, term, count(*) AS c FROM t GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), sz AS (SELECT leaf, sum(c) AS size FROM tf GROUP BY leaf),
sc AS (SELECT leaf AS cluster, term, c AS count, c / CAST(size AS DOUBLE) * ln(1 + (SELECT count(DISTINCT leaf) FROM assigned WHERE leaf >= 0) / CAST(df AS DOUBLE)) AS score FROM tf JOIN df USING (term) JOIN sz USING (leaf)),
rk AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, term) AS rank FROM sc)"""


@query(PA + _SCORED + " SELECT cluster, term, count, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= 10")
def ctfidf(spark, d):
    out = cl.ctfidf(tm.labelled(spark, d), "abstract")
    return out.select("cluster", "term", "count", r6("score", "score"), "rank")


@query(PA + ", c AS (SELECT leaf, venue, count(*) AS n FROM papers JOIN assigned USING (doc_id) WHERE leaf >= 0 GROUP BY ALL) SELECT leaf, CAST(sum(n) AS BIGINT) AS n, string_agg(venue || ':' || n, ',' ORDER BY n DESC, venue) AS breakdown_text FROM c GROUP BY leaf")
def venue_breakdown(spark, d):
    return cl.composition(tm.labelled(spark, d)).drop("breakdown")


_CROSS = PA + ", x AS (SELECT leaf, count(*) AS n, avg(CASE WHEN venue IN ('en') THEN 1.0 ELSE 0 END) AS a, avg(CASE WHEN venue IN ('de', 'fr') THEN 1.0 ELSE 0 END) AS b FROM papers JOIN assigned USING (doc_id) WHERE leaf >= 0 GROUP BY leaf)"


def _cross(spark: SparkSession, d: str) -> DataFrame:
    return cl.cross_index(tm.labelled(spark, d), one=["en"], other=["de", "fr"])


@query(_CROSS + " SELECT leaf, n, round(a, 6) AS one_frac, round(b, 6) AS other_frac, round(2 * least(a, b), 6) AS cross_index FROM x")
def cross_venue_index(spark, d):
    return _cross(spark, d).select("leaf", "n", r6("one_frac", "one_frac"), r6("other_frac", "other_frac"), r6("cross_index", "cross_index"))


@query(_CROSS + " SELECT leaf, round(2 * least(a, b), 6) AS cross_index FROM x WHERE 2 * least(a, b) >= 0.3 ORDER BY 2 * least(a, b) DESC, leaf LIMIT 5")
def cross_venue_top(spark, d):
    return _cross(spark, d).filter("cross_index >= 0.3").orderBy(F.desc("cross_index"), "leaf").limit(5).select("leaf", r6("cross_index", "cross_index"))


@query(PA + ", c AS (SELECT leaf, mid, count(*) AS n FROM assigned WHERE leaf >= 0 GROUP BY ALL), b AS (SELECT leaf, max(n) AS best, sum(n) AS n FROM c GROUP BY leaf) SELECT round(sum(best) / CAST(sum(n) AS DOUBLE), 6) AS nesting FROM b")
def nesting_score(spark, d):
    return cl.nesting(tm.assignments(spark, d), "leaf", "mid").select(r6("nesting", "nesting"))


@query(PA + """, c AS (SELECT leaf, mid, CAST(count(*) AS DOUBLE) AS n FROM assigned GROUP BY ALL), a AS (SELECT sum(n) AS n FROM c GROUP BY leaf), b AS (SELECT sum(n) AS n FROM c GROUP BY mid),
s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS i, (SELECT sum(n * (n - 1) / 2) FROM a) AS sa, (SELECT sum(n * (n - 1) / 2) FROM b) AS sb, (SELECT sum(n) FROM c) AS n)
SELECT round(coalesce((i - sa * sb / (n * (n - 1) / 2)) / nullif((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2), 0), 1), 6) AS ari FROM s""")
def ari_two_levels(spark, d):
    return cl.adjusted_rand(tm.assignments(spark, d), "leaf", "mid").select(r6("ari", "ari"))


_STRIDED = ", r AS (SELECT leaf, doc_id, title, row_number() OVER (PARTITION BY leaf ORDER BY doc_id) AS r, greatest(1, count(*) OVER (PARTITION BY leaf) // 8) AS step FROM papers JOIN assigned USING (doc_id) WHERE leaf >= 0)"


@query(PA + _STRIDED + " SELECT leaf, doc_id, title, CAST((r - 1) // step AS INTEGER) AS place FROM r WHERE (r - 1) % step = 0 AND r <= step * 8")
def strided_titles(spark, d):
    return cl.strided_titles(tm.labelled(spark, d))


_ASKED = cl.PROMPT.replace("'", "''").split("%s")


@query(PA + _SCORED + _STRIDED + f""", words AS (SELECT cluster AS leaf, string_agg(term, ', ' ORDER BY rank) AS terms FROM rk WHERE rank <= 10 GROUP BY cluster),
said AS (SELECT leaf, string_agg('- ' || title, chr(10) ORDER BY r) AS titles FROM r WHERE (r - 1) % step = 0 AND r <= step * 8 GROUP BY leaf)
SELECT leaf, '{_ASKED[0]}' || terms || '{_ASKED[1]}' || coalesce(titles, '') || '{_ASKED[2]}' AS prompt FROM words LEFT JOIN said USING (leaf)""")
def label_prompts(spark, d):
    p = tm.labelled(spark, d)
    return cl.prompts(cl.ctfidf(p, "abstract"), cl.strided_titles(p))


_TITLE_TERMS = "list_filter(regexp_extract_all(lower(title), '[a-z][a-z-]{2,}'), lambda w: NOT list_contains([" + ", ".join(f"'{w}'" for w in tx.TITLE_STOP_WORDS) + "], w))"


@query(PA + f""", t AS (SELECT leaf, unnest({_TITLE_TERMS}) AS term FROM papers JOIN assigned USING (doc_id) WHERE leaf >= 0), c AS (SELECT leaf, term, count(*) AS n FROM t GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY n DESC, term) AS r FROM c), l AS (SELECT leaf, string_agg(term, ' / ' ORDER BY r) AS label FROM k WHERE r <= 3 GROUP BY leaf)
SELECT leaf, coalesce(label, 'Unlabelled') AS label FROM (SELECT DISTINCT leaf FROM assigned WHERE leaf >= 0) LEFT JOIN l USING (leaf)""")
def fallback_labels(spark, d):
    return cl.common_title_terms(tm.labelled(spark, d))


@query(PA + """, w AS (SELECT doc_id, leaf, mid, mega FROM assigned), c AS (SELECT cut, lab, count(*) AS n FROM (UNPIVOT (SELECT doc_id, mid, mega FROM w) ON mid, mega INTO NAME cut VALUE lab) GROUP BY ALL),
s AS (SELECT cut, count(CASE WHEN lab >= 0 THEN 1 END) AS clusters, round(sum(CASE WHEN lab < 0 THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE), 6) AS noise FROM c GROUP BY cut),
f AS (SELECT 'mid' AS cut, leaf, mid AS lab, count(*) AS n FROM w WHERE leaf >= 0 GROUP BY ALL UNION ALL SELECT 'mega', leaf, mega, count(*) FROM w WHERE leaf >= 0 GROUP BY ALL),
b AS (SELECT cut, leaf, max(n) AS best, sum(n) AS n FROM f GROUP BY ALL), g AS (SELECT cut, round(sum(best) / CAST(sum(n) AS DOUBLE), 6) AS nesting FROM b GROUP BY cut)
SELECT cut, clusters, noise, nesting FROM s JOIN g USING (cut)""")
def cluster_sweep(spark, d):
    return cl.sweep(tm.assignments(spark, d), "leaf", ["mid", "mega"]).select("cut", "clusters", r6("noise", "noise"), r6("nesting", "nesting"))


def _ari_sql(x: str, y: str) -> str:
    c = f"(SELECT {x} AS x, {y} AS y, CAST(count(*) AS DOUBLE) AS n FROM assigned GROUP BY ALL)"
    return f"""SELECT '{x}' AS a, '{y}' AS b, round(coalesce((i - sa * sb / m) / nullif((sa + sb) / 2 - sa * sb / m, 0), 1), 6) AS ari FROM (SELECT
  (SELECT sum(n * (n - 1) / 2) FROM {c}) AS i, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM {c} GROUP BY x)) AS sa,
  (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM {c} GROUP BY y)) AS sb, (SELECT sum(n) * (sum(n) - 1) / 2 FROM {c}) AS m)"""


@query(PA + " " + " UNION ALL ".join(_ari_sql(x, y) for x, y in (("leaf", "mid"), ("leaf", "mega"), ("mid", "mega"))))
def level_stability(spark, d):
    return cl.seed_stability(tm.assignments(spark, d), ["leaf", "mid", "mega"]).select("a", "b", r6("ari", "ari"))


@query()
def vocabulary_coherence(spark, d):
    sets = tm.labelled(spark, d).select(F.col("doc_id").alias("id"), F.col("leaf").alias("cluster"), tx.title_terms(F.col("title")).alias("keywords"))
    return ve.purity_lift(sets, least=5)


@query(_KEYS + " SELECT lang, key, CAST(row_number() OVER (PARTITION BY lang ORDER BY key) AS INTEGER) AS k FROM t WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.lang = t.lang AND o.key = t.key) QUALIFY k <= 2")
def unmatched_keys(spark, d):
    docs = table(spark, d, "documents")
    langs = docs.select("lang").distinct()
    langs = F.broadcast(langs) if langs.limit(1001).count() <= 1000 else langs
    theirs = _sentences(table(spark, d, "benchmark")).distinct().crossJoin(langs)  # a row per key and language is what is ranked
    return qu.unmatched_sample(_sentences(docs, "lang"), theirs, "lang", "key")


@query()
def blog_html(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.markdown(F.col("text")).alias("html"))


# --- vectors ----------------------------------------------------------------------------------


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))


_KNN = """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), u AS (SELECT id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
s AS (SELECT a.id AS src, b.id AS dst, list_dot_product(a.e, b.e) AS sim FROM u a JOIN u b ON a.id <> b.id),
knn AS (SELECT src, dst, CAST(row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS INTEGER) AS rank, sim FROM s QUALIFY rank <= 10)"""


@query(_KNN + " SELECT src, dst, rank, round(sim, 6) AS sim FROM knn")
def knn_exact(spark, d):
    return ve.knn(_vectors(spark, d), 10).select("src", "dst", "rank", r6("sim", "sim"))


@query(_KNN + "," + PAPERS_SQL + """, e AS (SELECT a.keywords AS a, b.keywords AS b FROM knn JOIN papers a ON a.doc_id = src JOIN papers b ON b.doc_id = dst WHERE len(a.keywords) > 0 AND len(b.keywords) > 0)
SELECT count(*) AS pairs, round(avg(len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE)), 6) AS mean_jaccard, round(avg(CASE WHEN list_has_any(a, b) THEN 1.0 ELSE 0 END), 6) AS any_shared FROM e""")
def knn_label_agreement(spark, d):
    sets = tm.papers(spark, d).select(F.col("doc_id").alias("id"), "keywords")
    return ve.agreement(ve.knn(_vectors(spark, d), 10), sets).select("pairs", r6("mean_jaccard", "mean_jaccard"), r6("any_shared", "any_shared"))


@query()
def knn_overlap(spark, d):
    v = _vectors(spark, d)
    return ve.overlap(ve.approximate_knn(v, 10), ve.knn(v, 10))


def _keyword_sets(spark: SparkSession, d: str) -> DataFrame:
    return tm.labelled(spark, d).select(F.col("doc_id").alias("id"), F.col("leaf").alias("cluster"), "keywords")


@query(PA + """, s AS (SELECT doc_id AS id, leaf AS cluster, keywords FROM papers JOIN assigned USING (doc_id) WHERE leaf >= 0 AND len(keywords) > 0),
p AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY md5(CAST(id AS VARCHAR)), id) - 1 AS p, count(*) OVER (PARTITION BY cluster) AS n FROM s),
e AS (SELECT a.cluster, a.n, a.keywords AS a, b.keywords AS b FROM p a CROSS JOIN range(1, 21) t(k) JOIN p b ON b.cluster = a.cluster AND b.p = (a.p + k) % a.n WHERE k <= a.n // 2 AND (k * 2 <> a.n OR a.p < k))
SELECT cluster, count(*) AS pairs, round(avg(len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE)), 6) AS purity, any_value(n) AS size FROM e GROUP BY cluster""")
def cluster_purity(spark, d):
    return ve.purity(_keyword_sets(spark, d)).select("cluster", "pairs", r6("purity", "purity"), "size")


@query()
def cluster_purity_lift(spark, d):
    return ve.purity_lift(_keyword_sets(spark, d))


@query()
def approximate_neighbours(spark, d):
    return ve.approximate_knn(_vectors(spark, d), 10)


@query()
def pca_coordinates(spark, d):
    return ve.pca(_vectors(spark, d), 10)[0]


@query()
def map_trustworthiness(spark, d):
    v = _vectors(spark, d)
    return spark.createDataFrame([(ve.trustworthiness(v, ve.pca(v, 2)[0]),)], "trustworthiness double")


@query()
def null_model(spark, d):
    return ve.null_vectors(_vectors(spark, d), "shuffled")


@query()
def venue_predictability(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").cast("string").alias("kind"))
    return spark.createDataFrame([tuple(ve.predictability(v, "kind").values())], "accuracy double, macro_f1 double, majority double")


@query()
def hashed_embeddings(spark, d):
    docs = tm.papers(spark, d).select("doc_id", tx.terms(tx.embedding_text(F.col("title"), F.col("abstract"))).alias("tokens"))
    return ve.hashed_embedding(docs).select("doc_id", "vec")


@query()
def density_clusters(spark, d):
    from lexigrid.operators import density

    return density.hdbscan(ve.pca(_vectors(spark, d), 10)[0].withColumnRenamed("coords", "vec"), 15, 5)


@query()
def map_layout(spark, d):
    from lexigrid.operators import density

    return density.umap(_vectors(spark, d), 15)


# --- text and records ---------------------------------------------------------------------------


@query(r"""WITH m AS (SELECT page_id, regexp_extract_all(html, '(?s)<a [^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1) AS h, regexp_extract_all(html, '(?s)<a [^>]*href="([^"]*)"[^>]*>(.*?)</a>', 2) AS l FROM pages)
SELECT page_id, CAST(i - 1 AS INTEGER) AS place, h[i] AS href, regexp_replace(l[i], '<[^>]+>', '', 'g') AS label FROM m, unnest(range(1, len(h) + 1)) t(i)""")
def html_links(spark, d):
    return records.html_links(table(spark, d, "pages"))


@query(r"SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, trim(regexp_replace(lower(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)), '[^a-z0-9]+', ' ', 'g')) AS key FROM pages")
def page_titles(spark, d):
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    return table(spark, d, "pages").select("page_id", title.alias("title"), tx.ascii_key(title).alias("key"))


@query(r"""WITH c AS (SELECT doc_id, text, substr(text, 1, 220) AS h FROM documents) SELECT doc_id, CASE WHEN length(text) <= 220 THEN text ELSE (CASE WHEN contains(h, ' ') THEN regexp_replace(h, '(?s) [^ ]*$', '') ELSE h END) || '…' END AS snippet FROM c""")
def snippets(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.snippet(F.col("text")).alias("snippet"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_notes(spark, d):
    return table(spark, d, "events").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


@query(PA + f" SELECT doc_id, CAST(len({_TERMS}) AS BIGINT) AS n_terms FROM papers JOIN assigned USING (doc_id)")
def term_counts(spark, d):
    return tm.papers(spark, d).select("doc_id", F.size(tx.terms(F.col("abstract"))).cast("long").alias("n_terms"))


@query()
def file_checksums(spark, d):
    from lexigrid.sources.release import checksums

    return checksums(spark, d)


@query()
def cache_inventory(spark, d):
    """Raw objects with their sizes and hashes, as the cache lists them."""
    from lexigrid.sources.release import checksums

    files = checksums(prepare(spark), d).checkpoint()  # a sort reads its input twice
    return files.select(F.element_at(F.split("path", "/"), -1).alias("part"), F.col("bytes").alias("length"), "sha256").filter(~F.col("part").endswith(".meta.json")).orderBy("part")


from lexigrid.plans import fields  # noqa: E402, F401  registers its queries, and needs query() from here
