"""Text functions on columns; Python (Arrow) only where Spark has no built-in.

Patterns use explicit character classes so that Java and RE2 agree on them.
"""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as Python's str.split() has it.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# Words that carry no topic, for vocabularies of titles and abstracts.
TERM_STOP_WORDS = """
a an the of and or for to in on with by from as at is are be we our this that
these those using use used via towards toward new novel approach method model models
learning based can it its into more than not do does paper study analysis task tasks
data results propose present show demonstrate also however between which
""".split()

# The shorter list for title vocabularies.
TITLE_STOP_WORDS = """
a an the of and or for to in on with by from as at is are be we our this that
these those using use used via towards toward new novel approach method model models
learning based can it its into more than not do does paper study analysis task tasks
data llm llms large language
""".split()

TERM_PATTERN, TITLE_PATTERN = "[a-z][a-z0-9-]{2,}", "[a-z][a-z-]{2,}"


def text_of(c: Column) -> Column:
    """The string, or an empty one."""
    return F.coalesce(c.cast("string"), F.lit(""))


def collapse_space(c: Column) -> Column:
    """White-space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(text_of(c), "<[^>]+>", "")


@F.pandas_udf(StringType())
def unescape(s: pd.Series) -> pd.Series:
    """HTML character references decoded; Spark has no such function."""
    return s.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def casefold(s: pd.Series) -> pd.Series:
    """Full case folding, which lower() is not (ß, final sigma)."""
    return s.map(str.casefold, na_action="ignore")


@F.pandas_udf(StringType())
def _decomposed(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKD", html.unescape(html.unescape(x))), na_action="ignore")


def clean_markup(c: Column) -> Column:
    """Tags removed, references decoded, white space collapsed."""
    return collapse_space(unescape(strip_tags(c)))


def ascii_key(c: Column) -> Column:
    """Lower case, everything but a-z and 0-9 to single spaces, trimmed: a match key without Python."""
    return F.trim(F.regexp_replace(F.lower(text_of(c)), "[^a-z0-9]+", " "))


def title_key(c: Column) -> Column:
    """The match key of a title that may hold references (escaped twice) and accents.

    Compatibility decomposition splits an accented letter, and its mark becomes a
    space, as the keys it must equal have it.
    """
    return ascii_key(_decomposed(text_of(c)))


def terms(c: Column, pattern: str = TERM_PATTERN, stop: list[str] | None = None) -> Column:
    """Lower-case terms in order, stop words left out."""
    found = F.regexp_extract_all(F.lower(text_of(c)), F.lit(pattern), F.lit(0))
    words = F.array(*(F.lit(w) for w in (TERM_STOP_WORDS if stop is None else stop))) if stop is None or stop else None
    return found if words is None else F.filter(found, lambda w: ~F.array_contains(words, w))


def title_terms(c: Column) -> Column:
    return F.array_distinct(terms(c, TITLE_PATTERN, TITLE_STOP_WORDS))


def keyword_set(keywords: Column) -> Column:
    """Distinct keywords in lower case with collapsed white space; blank ones dropped."""
    tidy = F.transform(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: collapse_space(F.lower(k)))
    return F.array_distinct(F.filter(tidy, lambda k: k != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets as arrays; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def holds_all(fields: list[Column], words: list[str]) -> Column:
    """Every word is a substring of some field."""
    out = F.lit(True)
    for w in words:
        hit = F.lit(False)
        for f in fields:
            hit = hit | f.contains(w)
        out = out & hit
    return out


def excerpt(abstract: Column, folded: Column, words: list[str], size: int = 320, before: int = 80) -> Column:
    """``size`` characters of a longer text, from shortly before the first word found in its folded form."""
    whole = text_of(abstract)
    at = F.array_min(F.filter(F.array(*(F.instr(folded, F.lit(w)) - 1 for w in words)), lambda x: x >= 0)) if words else F.lit(None).cast("int")
    start = F.greatest(F.lit(0), at - before)
    cut = F.concat(F.when(start > 0, "…").otherwise(""), F.substr(whole, start + 1, F.lit(size)), F.when(start + size < F.length(whole), "…").otherwise(""))
    return F.when((F.length(whole) > size) & at.isNotNull(), cut).otherwise(F.substring(whole, 1, size))


def snippet(c: Column, size: int = 220) -> Column:
    """The first ``size`` characters, back to the last space, with an ellipsis if anything is left out."""
    whole = text_of(c)
    head = F.substring(whole, 1, size)
    return F.when(F.length(whole) <= size, whole).otherwise(F.concat(F.when(F.instr(head, " ") > 0, F.regexp_replace(head, " [^ ]*$", "")).otherwise(head), F.lit("…")))


def author_line(names: Column, shown: int = 3) -> Column:
    """The first names, then "et al." """
    all_names = F.coalesce(names, F.array().cast("array<string>"))
    return F.concat(F.array_join(F.slice(all_names, 1, shown), ", "), F.when(F.size(all_names) > shown, ", et al.").otherwise(""))


def full_name(first: Column, last: Column) -> Column:
    return F.concat_ws(" ", F.nullif(first, F.lit("")), F.nullif(last, F.lit("")))


def split_list(c: Column, sep: str = ",") -> Column:
    """Trimmed, non-blank parts."""
    return F.filter(F.transform(F.split(text_of(c), sep), collapse_space), lambda x: x != "")


def escape_html(c: Column, apostrophe: bool = True) -> Column:
    out = c
    for plain, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), *((("'", "&#x27;"),) if apostrophe else ())):
        out = F.replace(out, F.lit(plain), F.lit(reference))
    return out


def slug(url: Column) -> Column:
    """The last path segment without .html."""
    return F.regexp_replace(F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1), r"\.html$", "")


def paper_id(venue: Column, year: Column, source_id: Column) -> Column:
    return F.concat_ws(":", venue, year.cast("string"), source_id.cast("string"))


def embedding_text(title: Column, abstract: Column) -> Column:
    """Title, full stop, abstract; a missing part is empty."""
    return F.trim(F.concat(text_of(title), F.lit(". "), text_of(abstract)))


def breadcrumb(*levels: Column) -> Column:
    return F.concat_ws(" › ", *levels)


def unquote(c: Column) -> Column:
    """Without spaces and double quotes at the ends."""
    return F.btrim(F.trim(c), F.lit('"'))


def search_text(label: Column, keywords: Column, title: Column) -> Column:
    return F.concat_ws(" ", label, F.array_join(keywords, " "), title)


def length_class(volume: Column, main_volumes: list[str]) -> Column:
    """A volume named long or short is that; of two volumes the first is long, the second short; else null."""
    named = F.when(volume.isin("long", "short"), volume)
    if len(main_volumes) == 2:
        named = named.when(volume == main_volumes[0], "long").when(volume == main_volumes[1], "short")
    return named


#: What a line of text is cut into; of marks that overlap the one that opens first counts, and nothing is marked inside code.
_CODE, _LINK, _BOLD, _ITALIC = r"`[^`]++`", r"\[[^\[\]]++\]\([^()\s]++\)", r"\*\*(?=\S)(?:(?!\*\*).)++\*\*", r"\*(?=[^\s*])[^*]++\*"
_MARKED = "|".join((_CODE, _LINK, _BOLD, _ITALIC))


def _tagged(piece: Column) -> Column:
    """One marked piece as HTML; a link's or an emphasis' own text may hold one more level of marks."""
    size = F.length(piece)

    def inside(at: int) -> Column:
        return F.substr(piece, F.lit(at + 1), size - 2 * at)

    def wrapped(tag: str, body: Column) -> Column:
        return F.concat(F.lit(f"<{tag}>"), body, F.lit(f"</{tag}>"))

    label, target = (F.regexp_extract(piece, r"^\[(.*)\]\((.*)\)$", i) for i in (1, 2))
    link = F.concat(F.lit('<a href="'), target, F.lit('" target="_blank" rel="noopener">'), label, F.lit("</a>"))
    nested = F.regexp_replace(inside(2), r"(?<!\*)\*([^*]++)\*(?!\*)", "<em>$1</em>")
    return F.when(piece.startswith("`"), wrapped("code", inside(1))).when(piece.startswith("["), link).when(piece.startswith("**"), wrapped("strong", nested)).otherwise(wrapped("em", inside(1)))


def inline_markdown(c: Column) -> Column:
    """Code, bold, italic and links of one line of text: the line is cut at its marked pieces, which are wrapped one by one."""
    safe = escape_html(c)
    marked = F.transform(F.regexp_extract_all(safe, F.lit(_MARKED), F.lit(0)), _tagged)
    return F.array_join(F.zip_with(F.split(safe, _MARKED, -1), F.concat(marked, F.array(F.lit(""))), lambda between, piece: F.concat(between, piece)), "")


def markdown(c: Column) -> Column:
    """A small Markdown to HTML: headings, bullet lists (with wrapped items), figures, paragraphs.

    Each line gets a kind; an aggregate over the lines gathers blocks of one kind.
    """
    lines = F.transform(F.split(text_of(c), "\n"), lambda x: F.trim(x))
    figure = r"^!\[([^\]]*)\]\(([^)]+)\)$"

    def kind(x: Column) -> Column:
        return F.when(x == "", "blank").when(x.rlike(figure), "figure").when(x.startswith("## "), "h2").when(x.startswith("# "), "h1").when(x.startswith("- "), "item").otherwise("text")

    start = F.array().cast("array<struct<kind:string,text:string,open:boolean>>")

    def step(acc: Column, x: Column) -> Column:
        k = kind(x)
        last = F.try_element_at(acc, F.lit(-1))
        goes_on = (k == "text") & last["open"] & last["kind"].isin("text", "item")
        body = F.when(k == "h2", F.substr(x, F.lit(4))).when(k == "h1", F.substr(x, F.lit(3))).when(k == "item", F.substr(x, F.lit(3))).otherwise(x)
        new = F.struct(k.alias("kind"), body.alias("text"), k.isin("text", "item").alias("open"))
        joined = F.struct(last["kind"].alias("kind"), F.concat_ws(" ", last["text"], x).alias("text"), F.lit(True).alias("open"))
        return F.when(F.coalesce(goes_on, F.lit(False)), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(new)))

    blocks = F.filter(F.aggregate(lines, start, step), lambda b: b["kind"] != "blank")

    def rendered(b: Column, i: Column) -> Column:
        before, after = F.get(blocks, i - 1)["kind"], F.get(blocks, i + 1)["kind"]
        alt, src = (F.regexp_extract(b["text"], figure, g) for g in (1, 2))
        picture = F.concat(F.lit('<figure><img src="'), escape_html(src), F.lit('" alt="'), escape_html(alt), F.lit('" loading="lazy">'), F.when(alt != "", F.concat(F.lit("<figcaption>"), inline_markdown(alt), F.lit("</figcaption>"))).otherwise(""), F.lit("</figure>\n"))
        item = F.concat(F.when(F.coalesce(before == "item", F.lit(False)), "").otherwise("<ul>"), F.lit("<li>"), inline_markdown(b["text"]), F.lit("</li>"), F.when(F.coalesce(after == "item", F.lit(False)), "").otherwise("</ul>\n"))
        tag = F.when(b["kind"] == "text", "p").otherwise(b["kind"])
        return F.when(b["kind"] == "figure", picture).when(b["kind"] == "item", item).otherwise(F.concat(F.lit("<"), tag, F.lit(">"), inline_markdown(b["text"]), F.lit("</"), tag, F.lit(">\n")))

    return F.regexp_replace(F.array_join(F.transform(blocks, rendered), ""), "\n$", "")
