"""Registered queries of the text functions, and of the readers and writers of source records.

Source files are made from the documents, one record each, so that SQL can say what
reading them must give.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.functions import stats as st
from lexigrid.functions import text as tx
from lexigrid.operators import quality as qu
from lexigrid.plans import testmodel as tm
from lexigrid.plans.registry import PA, PAR, P, query, r6, trend
from lexigrid.plans.testmodel import table
from lexigrid.runtime import shared_dir
from lexigrid.sources import corpus, records

_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _tidy(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SPACE}', ' ', 'g'))"


def _escaped(x: str) -> str:
    for plain, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        x = f"replace({x}, '{plain}', '{reference}')"
    return x


def _split_accents(x: str) -> str:
    for base, letters in (("a", "àáâãäå"), ("c", "ç"), ("e", "èéêë"), ("i", "ìíîï"), ("n", "ñ"), ("o", "òóôõö"), ("u", "ùúûü"), ("y", "ýÿ")):
        x = f"regexp_replace({x}, '[{letters}]', '{base} ', 'g')"
    return x


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for what a query writes and reads again."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- text ---------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {_tidy('text')} AS tidy FROM documents")
def collapsed_text(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.collapse_space(F.col("text")).alias("tidy"))


@query(P + " SELECT doc_id, replace(lower(title), 'ß', 'ss') AS folded FROM papers")
def casefolded_titles(spark, d):
    return tm.papers(spark, d).select("doc_id", tx.casefold(F.col("title")).alias("folded"))


@query(P + f" SELECT doc_id, trim(regexp_replace({_split_accents('lower(title)')}, '[^a-z0-9]+', ' ', 'g')) AS key FROM papers")
def title_keys(spark, d):
    return tm.papers(spark, d).select("doc_id", tx.title_key(F.col("title")).alias("key"))


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(lower(text), ' '), lambda k: {_tidy('k')}), lambda k: k <> ''))), '|') AS keywords FROM documents")
def keyword_sets(spark, d):
    words = tx.keyword_set(F.split("text", " "))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(words), "|").alias("keywords"))


_NAMES = f"list_filter(list_transform(string_split(text, ','), lambda k: {_tidy('k')}), lambda k: k <> '')"


@query(f"SELECT doc_id, CAST(len(n) AS INTEGER) AS n_names, array_to_string(n[1:3], ', ') || CASE WHEN len(n) > 3 THEN ', et al.' ELSE '' END AS line FROM (SELECT doc_id, {_NAMES} AS n FROM documents)")
def author_lines(spark, d):
    names = tx.split_list(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(names).alias("n_names"), tx.author_line(names).alias("line"))


@query("SELECT doc_id, concat_ws(' ', CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE lang END, CASE WHEN doc_id % 5 > 0 THEN source END) AS name FROM documents")
def full_names(spark, d):
    """Every third first name is null, another third and every fifth last name empty."""
    first = F.when(F.col("doc_id") % 3 == 1, "").when(F.col("doc_id") % 3 == 2, F.col("lang"))
    last = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("source"))
    return table(spark, d, "documents").select("doc_id", tx.full_name(first, last).alias("name"))


@query(P + " SELECT doc_id, trim(title || '. ' || abstract) AS text FROM papers")
def embedding_texts(spark, d):
    return tm.papers(spark, d).select("doc_id", tx.embedding_text(F.col("title"), F.col("abstract")).alias("text"))


@query(f"SELECT page_id, {_escaped('html')} AS escaped FROM pages")
def escaped_html(spark, d):
    return table(spark, d, "pages").select("page_id", tx.escape_html(F.col("html")).alias("escaped"))


@query(r"SELECT page_id, regexp_replace(regexp_extract(rtrim(url, '/'), '([^/]*)$', 1), '\.html$', '') AS slug FROM pages")
def url_slugs(spark, d):
    return table(spark, d, "pages").select("page_id", tx.slug(F.col("url")).alias("slug"))


@query(PAR + " SELECT doc_id, upper(venue) || ' › ' || category AS crumb FROM trend")
def breadcrumbs(spark, d):
    return trend(spark, d).select("doc_id", tx.breadcrumb(F.upper("venue"), F.col("category")).alias("crumb"))


@query(P + """ SELECT doc_id, trim(trim('  "' || title || '" '), '"') AS label FROM papers""")
def unquoted_labels(spark, d):
    return tm.papers(spark, d).select("doc_id", tx.unquote(F.concat(F.lit('  "'), "title", F.lit('" '))).alias("label"))


@query("SELECT doc_id, CASE lang WHEN 'de' THEN 'long' WHEN 'en' THEN 'short' END AS length FROM documents")
def length_classes(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.length_class(F.col("lang"), ["de", "en"]).alias("length"))


# --- numbers ------------------------------------------------------------------------------------


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), o AS (SELECT e AS o FROM v WHERE vec_id = 0)
SELECT vec_id, abs(round(1 - list_dot_product(e, o) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(o, o))), 6)) AS distance FROM v, o""")
def cosine_distances(spark, d):
    """Distance of every vector from that of id 0, one row, which is broadcast; abs() makes a rounded -0 a 0."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    origin = v.filter("vec_id = 0").select(F.col("embedding").alias("o"))
    return v.crossJoin(F.broadcast(origin)).select("vec_id", F.abs(r6(st.cosine_distance(F.col("embedding"), F.col("o")), "d")).alias("distance"))


@query("SELECT event_id, round_even(value * 10, 0) / 10 AS tenths, CAST(round_even(value / 2, 0) AS BIGINT) AS half FROM events")
def half_even_values(spark, d):
    return table(spark, d, "events").select("event_id", st.half_even(F.col("value"), 1).alias("tenths"), st.half_even(F.col("value") / 2).cast("long").alias("half"))


@query(P + " SELECT doc_id, round(40.0 + (year - 2018.0) * (640.0 / 7.0), 6) AS x, round(300.0 + length(title) * (-300.0 / 100.0), 6) AS y FROM papers")
def plot_points(spark, d):
    p = tm.papers(spark, d)
    return p.select("doc_id", r6(st.scaled(F.col("year"), 2018, 2025, 40.0, 680.0), "x"), r6(st.scaled(F.length("title"), 0, 100, 300.0, 0.0), "y"))


# --- sources ------------------------------------------------------------------------------------


@query(P + " SELECT paper_id, title, venue, year, source FROM papers")
def partitioned_store(spark, d):
    """Papers written by venue and year, and read again."""
    root = scratch(spark, "papers")
    corpus.write_partitioned(records.as_papers(tm.papers(spark, d).drop("authors")), root)
    return spark.read.parquet(root).select("paper_id", "title", "venue", "year", "source")


@query(PA + " SELECT leaf AS cluster_id, 'Leaf ' || leaf AS label, count(*) AS size, array_to_string(list_sort(list(DISTINCT venue)), '|') AS keywords, min(title) AS title FROM papers JOIN assigned USING (doc_id) WHERE leaf >= 0 GROUP BY leaf")
def labels_round_trip(spark, d):
    """Labels written as the JSON map of cluster ids, and read again."""
    path = scratch(spark, "labels")
    rows = tm.labelled(spark, d).filter("leaf >= 0").groupBy(F.col("leaf").cast("int").alias("cluster_id")).agg(
        F.count("*").alias("size"), F.array_sort(F.collect_set("venue")).alias("keywords"), F.array(F.min("title")).alias("sample_titles"))
    corpus.write_labels(rows.withColumn("label", F.concat(F.lit("Leaf "), F.col("cluster_id").cast("string"))), path)
    return corpus.read_labels(spark, path).select("cluster_id", "label", "size", F.array_join("keywords", "|").alias("keywords"), F.col("sample_titles")[0].alias("title"))


@query(P + f""" SELECT 'iclr:' || year || ':n' || doc_id AS paper_id, {_tidy('title')} AS title, {_tidy('abstract')} AS abstract, author, CASE WHEN doc_id % 3 = 0 THEN '~' || doc_id END AS author_id,
CASE WHEN len(keywords) > 0 THEN array_to_string(list_sort(keywords), '|') END AS keywords, CASE WHEN doc_id % 2 = 0 THEN venue END AS primary_area FROM papers""")
def note_papers(spark, d):
    """Notes of both forms: fields as they are for odd ids, under "value" for even ones."""
    p = tm.papers(spark, d)
    fields = {
        "title": F.col("title"), "abstract": F.col("abstract"), "authors": F.col("authors.name"), "keywords": F.array_sort("keywords"),
        "authorids": F.array(F.concat(F.when(F.col("doc_id") % 3 == 0, "~").otherwise("mail"), F.col("doc_id").cast("string"))),
    }
    plain = F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())))
    wrapped = F.to_json(F.struct(*(F.struct(c.alias("value")).alias(k) for k, c in (fields | {"primary_area": F.col("venue")}).items())))
    content = F.when(F.col("doc_id") % 2 == 0, wrapped).otherwise(plain)
    notes = p.select("year", F.concat(F.lit('{"notes":[{"id":"n'), F.col("doc_id").cast("string"), F.lit('","content":'), content, F.lit("}]}")).alias("json"))
    return records.openreview_papers(notes).select("paper_id", "title", "abstract", F.col("authors")[0]["name"].alias("author"), F.col("authors")[0]["source_author_id"].alias("author_id"), F.array_join("keywords", "|").alias("keywords"), "primary_area")


def _xml(spark: SparkSession, d: str) -> DataFrame:
    """A collection file per document; every fifth entry is front matter, every third abstract a CDATA section, every fourth has a comment."""
    text, of = F.col("abstract"), F.col("doc_id").cast("string")
    abstract = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<![CDATA["), text, F.lit("]]>"))).otherwise(tx.escape_html(text))
    parts = [
        F.lit('<collection><volume id="'), F.col("venue"), F.lit('"><paper id="'), of, F.lit('"><title>'), tx.escape_html(F.col("title")), F.lit(" <i>of <b>"), F.col("source"), F.lit("</b></i></title>"),
        F.when(F.col("doc_id") % 4 == 0, "<!-- <title>no</title> </paper> -->").otherwise(""),
        F.lit('<author id="'), of, F.lit('"><first>A</first><last>'), F.col("source"), F.lit("</last></author><author><last>Solo</last></author><abstract>"), abstract, F.lit("</abstract><pages>"),
        F.when(F.col("doc_id") % 5 == 0, "i-x").otherwise("1-9"), F.lit("</pages><url>x."), of, F.lit("</url></paper></volume></collection>"),
    ]
    return tm.papers(spark, d).select("doc_id", "venue", "year", F.concat(F.lit("c"), of).alias("collection"), F.array(F.lit("de"), F.lit("en")).alias("main_volumes"), F.concat(*parts).alias("xml"))


@query(P + f""" SELECT venue || ':' || year || ':x.' || doc_id AS paper_id, {_tidy("title || ' of ' || source")} AS title, {_tidy('abstract')} AS abstract, 'A ' || source || '|Solo' AS names,
CAST(doc_id AS VARCHAR) AS author_id, CASE venue WHEN 'de' THEN 'long' ELSE 'short' END AS length FROM papers WHERE venue IN ('de', 'en') AND doc_id % 5 <> 0""")
def xml_papers(spark, d):
    got = records.anthology_papers(_xml(spark, d))
    return got.select("paper_id", "title", "abstract", F.array_join("authors.name", "|").alias("names"), F.col("authors")[0]["source_author_id"].alias("author_id"), "length")


@query(P + f" SELECT venue, year, {_tidy('title')} AS title, trim(regexp_replace({_split_accents('lower(title)')}, '[^a-z0-9]+', ' ', 'g')) AS key FROM (SELECT * REPLACE (rtrim({_tidy('title')}, '.') AS title) FROM papers)")
def index_titles(spark, d):
    """Keys of an index's contributions; its proceedings entries are not among them."""
    xml = F.concat(F.lit("<r><proceedings><title>P</title></proceedings><inproceedings key='k'><title>"), tx.escape_html(F.col("title")), F.lit(".</title></inproceedings></r>"))
    return records.dblp_titles(tm.papers(spark, d).select("venue", "year", xml.alias("xml"))).select("venue", "year", "title", "key")


def _proceedings(spark: SparkSession, d: str) -> DataFrame:
    """A listing and a paper's page per document; two of three are main-track, every second abstract is nested."""
    of = F.col("doc_id").cast("string")
    track = F.when(F.col("doc_id") % 3 == 0, "datasets").otherwise("conference")
    entry = [F.lit('<li class="c" data-track="'), track, F.lit('"> <a href="/paper_files/paper/'), F.col("year").cast("string"), F.lit("/hash/"), of, F.lit('-Abstract.html">'), tx.escape_html(F.col("title")), F.lit('</a> <span class="paper-authors">A B, '), F.col("source"), F.lit('</span></li><a href="/paper_files/paper/'), F.col("year").cast("string"), F.lit("/vol"), of, F.lit('-main">')]
    body = tx.escape_html(F.col("abstract"))
    nested = F.concat(F.lit('<p class="paper-abstract"><p>'), body, F.lit("</p> <div>furniture</div></p>"))
    page = F.when(F.col("doc_id") % 2 == 0, nested).otherwise(F.concat(F.lit('<p class="paper-abstract">'), body, F.lit("</p></section>")))
    return tm.papers(spark, d).select("year", of.alias("hash"), F.concat(*entry).alias("html"), F.concat(page, F.lit('<a href="/f/'), of, F.lit('.pdf">')).alias("page"))


@query(P + f" SELECT 'neurips:' || year || ':' || doc_id AS paper_id, {_tidy('title')} AS title, {_tidy('abstract')} AS abstract, 'A B|' || source AS names, 'https://papers.nips.cc/f/' || doc_id || '.pdf' AS pdf_url FROM papers WHERE doc_id % 3 <> 0")
def proceedings_papers(spark, d):
    pages = _proceedings(spark, d)
    got = records.neurips_papers(records.neurips_listing(pages), pages.select("hash", F.col("page").alias("html")))
    return got.select("paper_id", "title", "abstract", F.array_join("authors.name", "|").alias("names"), "pdf_url")


@query(P + " SELECT year, '/paper_files/paper/' || year || '/vol' || doc_id || '-main' AS volume FROM papers WHERE doc_id % 3 = 0")
def main_volumes(spark, d):
    return records.main_volume(_proceedings(spark, d))


@query(P + f" SELECT 'icml:' || year || ':s' || doc_id AS paper_id, {_tidy('title')} AS title, CASE WHEN doc_id % 2 = 0 THEN {_tidy('abstract')} ELSE '' END AS abstract, 'A B|' || source AS names, CASE WHEN doc_id % 2 = 0 THEN 'https://p/s' || doc_id || '.pdf' END AS pdf_url FROM papers")
def listed_papers(spark, d):
    """Papers of a listing; every second one has no page of its own."""
    of = F.col("doc_id").cast("string")
    p = tm.papers(spark, d)
    entry = [F.lit('<div class="paper"><p class="title">'), tx.escape_html(F.col("title")), F.lit('</p><span class="authors">A B,&nbsp;'), F.col("source"), F.lit('</span>[<a href="https://p/s'), of, F.lit('.html">abs</a>]</div>')]
    page = F.concat(F.lit('<div id="abstract" class="x">'), tx.escape_html(F.col("abstract")), F.lit('</div><a href="https://p/s'), of, F.lit('.pdf">'))
    own = p.filter("doc_id % 2 = 0").select(F.concat(F.lit("s"), of).alias("slug"), page.alias("html"))
    got = records.pmlr_papers(records.pmlr_listing(p.select("year", F.concat(*entry).alias("html"))), own)
    return got.select("paper_id", "title", "abstract", F.array_join("authors.name", "|").alias("names"), "pdf_url")


@query("WITH need AS (SELECT DISTINCT source, v FROM documents, (VALUES ('de'), ('en'), ('it')) t(v)) SELECT source AS name, string_agg(v, '|' ORDER BY v) AS lacking FROM need WHERE NOT EXISTS (SELECT 1 FROM documents x WHERE x.source = need.source AND x.lang = v) GROUP BY source")
def absent_volumes(spark, d):
    have = table(spark, d, "documents").select(F.col("source").alias("name"), F.col("lang").alias("volume"))
    need = have.select("name", F.explode(F.array(F.lit("de"), F.lit("en"), F.lit("it"))).alias("volume"))
    return qu.absent_volumes(have, need).select("name", F.array_join("lacking", "|").alias("lacking"))
