"""Source documents to papers: listings in HTML, notes in JSON, collections in XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrid.functions import text as tx
from lexigrid.schema import PAPER

# The sites' markup, as their pages have it.
PMLR_ENTRY = r'(?s)<div class="paper">\s*<p class="title">(.*?)</p>.*?<span class="authors">(.*?)</span>.*?\[<a href="([^"]+?)">abs</a>\]'
PMLR_ABSTRACT, PMLR_PDF = r'(?s)<div[^>]*id="abstract"[^>]*>(.*?)</div>', r'href="([^"]+\.pdf)"'
NEURIPS_ENTRY = r'(?s)<li[^>]*data-track="([a-z_]+)"[^>]*>.*?href="(/paper_files/paper/(\d{4})/hash/([0-9a-f]+)-Abstract[^"]*)"[^>]*>(.*?)</a>.*?<span class="paper-authors">(.*?)</span>'
NEURIPS_NESTED, NEURIPS_PLAIN = r'(?s)<p class="paper-abstract">\s*<p>(.*?)</p>', r'(?s)<p class="paper-abstract">(.*?)</p>'
NEURIPS_VOLUME, NEURIPS_BASE = r'href="(/paper_files/paper/\d{4}/vol[^"]*main[^"]*)"', "https://papers.nips.cc"
MAIN_TRACKS = ["conference", "none"]


def every_match(text: Column, pattern: str, groups: list[str]) -> Column:
    """An array of structs of the groups of every match; each match is found once and its groups read from it."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.transform(found, lambda m: F.struct(*(F.regexp_extract(m, pattern, i + 1).alias(g) for i, g in enumerate(groups))))


def as_papers(df: DataFrame) -> DataFrame:
    """df in the schema of papers; missing columns are null."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in PAPER.fields))


def named_authors(names: Column) -> Column:
    return F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(None).cast("string").alias("source_author_id")))


def html_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """Every link of every page in order: page_id, place, href and its text."""
    rows = pages.select("page_id", F.posexplode(every_match(F.col(html), r'(?s)<a [^>]*href="([^"]*)"[^>]*>(.*?)</a>', ["href", "label"])).alias("place", "m"))
    return rows.select("page_id", "place", "m.href", tx.strip_tags(F.col("m.label")).alias("label"))


def pmlr_listing(pages: DataFrame) -> DataFrame:
    """year, slug, abs_url, title and author names of a proceedings listing (year, html)."""
    e = pages.select("year", F.explode(every_match(F.col("html"), PMLR_ENTRY, ["title", "authors", "abs_url"])).alias("e")).select("year", "e.*")
    return e.select("year", tx.slug(F.col("abs_url")).alias("slug"), "abs_url", tx.clean_markup(F.col("title")).alias("title"), tx.split_list(tx.clean_markup(F.col("authors"))).alias("names"))


def pmlr_papers(listing: DataFrame, pages: DataFrame) -> DataFrame:
    """Papers from a listing and the papers' pages (slug, html), where there are any."""
    got = pages.select("slug", tx.clean_markup(F.regexp_extract("html", PMLR_ABSTRACT, 1)).alias("abstract"), F.nullif(F.regexp_extract("html", PMLR_PDF, 1), F.lit("")).alias("pdf_url"))
    rows = listing.join(got, "slug", "left")
    return as_papers(rows.withColumns({"paper_id": tx.paper_id(F.lit("icml"), F.col("year"), F.col("slug")), "source_id": F.col("slug"), "abstract": F.coalesce("abstract", F.lit("")), "authors": named_authors(F.col("names")), "venue": F.lit("icml"), "track": F.lit("main"), "source": F.lit("pmlr"), "source_url": F.col("abs_url")}))


def neurips_listing(pages: DataFrame, main_only: bool = True) -> DataFrame:
    """year, hash, href, track, title and author names of a listing."""
    e = pages.select(F.explode(every_match(F.col("html"), NEURIPS_ENTRY, ["track", "href", "year", "hash", "title", "authors"])).alias("e")).select("e.*")
    rows = e.select(F.col("year").cast("int").alias("year"), "hash", "href", "track", tx.clean_markup(F.col("title")).alias("title"), tx.split_list(tx.clean_markup(F.col("authors"))).alias("names"))
    return rows.filter(F.col("track").isin(MAIN_TRACKS)) if main_only else rows


def main_volume(pages: DataFrame) -> DataFrame:
    """Listings without a main-track entry, with the link of the volume that has them."""
    tracks = F.transform(every_match(F.col("html"), NEURIPS_ENTRY, ["track"]), lambda m: m["track"])
    return pages.filter(~F.exists(tracks, lambda t: t.isin(MAIN_TRACKS))).select("year", F.nullif(F.regexp_extract("html", NEURIPS_VOLUME, 1), F.lit("")).alias("volume")).filter("volume is not null")


def neurips_abstract(html: Column) -> Column:
    """The nested form first, whose outer paragraph would take in page furniture, then the plain one."""
    return tx.clean_markup(F.coalesce(F.nullif(F.regexp_extract(html, NEURIPS_NESTED, 1), F.lit("")), F.regexp_extract(html, NEURIPS_PLAIN, 1)))


def neurips_papers(listing: DataFrame, pages: DataFrame) -> DataFrame:
    """Papers from a listing and the papers' pages (hash, html)."""
    pdf = F.regexp_extract("html", PMLR_PDF, 1)
    got = pages.select("hash", neurips_abstract(F.col("html")).alias("abstract"), F.when(pdf != "", F.concat(F.lit(NEURIPS_BASE), pdf)).alias("pdf_url"))
    rows = listing.drop("track").join(got, "hash", "left")
    return as_papers(rows.withColumns({"paper_id": tx.paper_id(F.lit("neurips"), F.col("year"), F.col("hash")), "source_id": F.col("hash"), "abstract": F.coalesce("abstract", F.lit("")), "authors": named_authors(F.col("names")), "venue": F.lit("neurips"), "track": F.lit("main"), "source": F.lit("nips"), "source_url": F.concat(F.lit(NEURIPS_BASE), "href")}))


def unwrapped(content: Column, field: str, kind: str) -> Column:
    """A field of a note: the value of {"value": x} where it is an object, else the field as it is."""
    return F.when(F.schema_of_variant(F.variant_get(content, f"$.{field}", "variant")).startswith("OBJECT"), F.try_variant_get(content, f"$.{field}.value", kind)).otherwise(F.try_variant_get(content, f"$.{field}", kind))


def openreview_papers(notes: DataFrame) -> DataFrame:
    """Papers from pages of notes (year, json): both forms of the interface."""
    note = T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("content", T.VariantType())]))
    rows = notes.select("year", F.explode(F.from_json("json", T.StructType([T.StructField("notes", note)]))["notes"]).alias("n")).select("year", F.col("n.id").alias("id"), F.col("n.content").alias("c"))
    many = lambda f: F.coalesce(unwrapped(F.col("c"), f, "array<string>"), F.array().cast("array<string>"))
    rows = rows.select("*", many("authors").alias("names"), many("authorids").alias("ids"), many("keywords").alias("words"))
    authors = F.transform("names", lambda n, i: F.struct(n.alias("name"), F.when(F.get("ids", i).startswith("~"), F.get("ids", i)).alias("source_author_id")))
    return as_papers(
        rows.select(
            tx.paper_id(F.lit("iclr"), F.col("year"), F.col("id")).alias("paper_id"), F.col("id").alias("source_id"), "year",
            *(tx.collapse_space(tx.text_of(unwrapped(F.col("c"), f, "string"))).alias(f) for f in ("title", "abstract")), authors.alias("authors"),
            F.lit("iclr").alias("venue"), F.lit("main").alias("track"), F.lit("openreview").alias("source"),
            F.concat(F.lit("https://openreview.net/forum?id="), "id").alias("source_url"), F.concat(F.lit("https://openreview.net/pdf?id="), "id").alias("pdf_url"),
            F.when(F.size("words") > 0, F.col("words")).alias("keywords"), unwrapped(F.col("c"), "primary_area", "string").alias("primary_area"),
        )
    )


def inner_text(markup: Column) -> Column:
    """The text of an element that holds markup."""
    return tx.clean_markup(markup)


_ASIDE = r"<!\[CDATA\[(?:(?!\]\]>)[\s\S])*+\]\]>|<!--(?:(?!-->)[\s\S])*+-->|<\?(?:(?!\?>)[\s\S])*+\?>"


def plain_xml(xml: Column) -> Column:
    """XML without comments and processing instructions, its CDATA sections as escaped text, so that a tag is one wherever it stands."""
    inner = lambda x: F.substr(x, F.lit(10), F.length(x) - 12)
    asides = F.transform(F.regexp_extract_all(xml, F.lit(_ASIDE), F.lit(0)), lambda x: F.when(x.startswith("<![CDATA["), tx.escape_html(inner(x))).otherwise(""))
    return F.array_join(F.zip_with(F.split(xml, _ASIDE, -1), F.concat(asides, F.array(F.lit(""))), lambda between, aside: F.concat(between, aside)), "")


def _elements(xml: Column, tag: str) -> Column:
    """The elements of a tag, as text; tags of this name do not nest in these files."""
    return F.regexp_extract_all(xml, F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>.*?</{tag}>"), F.lit(0))


def _inner(xml: Column, tag: str) -> Column:
    """What the first element of a tag holds; null without one."""
    return F.when(xml.rlike(rf"<{tag}[\s>]"), F.regexp_extract(xml, rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1))


def anthology_papers(collections: DataFrame) -> DataFrame:
    """Papers of main volumes from collection files (venue, year, collection, main_volumes, xml).

    Entries without a page range that starts with a digit are front matter.
    """
    volumes = collections.select("venue", "year", "collection", "main_volumes", F.explode(_elements(plain_xml(F.col("xml")), "volume")).alias("v"))
    volumes = volumes.withColumn("volume", F.regexp_extract("v", r'<volume[^>]*\sid="([^"]*)"', 1)).filter(F.array_contains("main_volumes", F.col("volume")))
    rows = volumes.select("*", F.explode(_elements(F.col("v"), "paper")).alias("p")).filter(tx.text_of(_inner(F.col("p"), "pages")).rlike(r"^\s*\d"))
    place = F.array_position("main_volumes", F.col("volume"))
    length = F.when(F.col("volume").isin("long", "short"), F.col("volume")).when((F.size("main_volumes") == 2) & (place == 1), "long").when((F.size("main_volumes") == 2) & (place == 2), "short")
    given = F.concat_ws("-", "collection", F.regexp_extract("p", r'<paper[^>]*\sid="([^"]*)"', 1))
    rows = rows.withColumns({"source_id": F.coalesce(_inner(F.col("p"), "url"), given), "length": length, "people": _elements(F.col("p"), "author"), "t": _inner(F.col("p"), "title"), "a": _inner(F.col("p"), "abstract"), "doi": _inner(F.col("p"), "doi")})
    # Names are cleaned as exploded rows, for the reference decoder is a Python function, which has no place inside transform.
    people = rows.select("source_id", F.posexplode("people").alias("i", "m")).select("source_id", "i", tx.full_name(inner_text(_inner(F.col("m"), "first")), inner_text(_inner(F.col("m"), "last"))).alias("name"), F.nullif(F.regexp_extract("m", r'<author[^>]*\sid="([^"]*)"', 1), F.lit("")).alias("source_author_id"))
    people = people.groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "name", "source_author_id"))), lambda x: F.struct(x["name"].alias("name"), x["source_author_id"].alias("source_author_id"))).alias("authors"))
    rows = rows.join(people, "source_id", "left")
    return as_papers(
        rows.select(
            tx.paper_id(F.col("venue"), F.col("year"), F.col("source_id")).alias("paper_id"), "source_id", inner_text(F.col("t")).alias("title"), inner_text(F.col("a")).alias("abstract"),
            F.coalesce("authors", F.array().cast(PAPER["authors"].dataType)).alias("authors"), "venue", "year", F.lit("main").alias("track"), "length", F.lit("anthology").alias("source"),
            F.concat(F.lit("https://aclanthology.org/"), "source_id", F.lit("/")).alias("source_url"), F.concat(F.lit("https://aclanthology.org/"), "source_id", F.lit(".pdf")).alias("pdf_url"), "doi",
        )
    )


def dblp_titles(files: DataFrame) -> DataFrame:
    """Title keys of contributions (venue, year, xml); the proceedings entry itself is front matter."""
    rows = files.select("venue", "year", F.explode(_elements(plain_xml(F.col("xml")), "inproceedings")).alias("p"))
    title = F.regexp_replace(inner_text(_inner(F.col("p"), "title")), r"\.+$", "")
    return rows.select("venue", "year", title.alias("title")).withColumn("key", tx.title_key(F.col("title")))
